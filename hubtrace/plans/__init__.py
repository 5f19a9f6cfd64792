from hubtrace.plans.construction import SPECS
from hubtrace.plans.incidents import INCIDENT_QUERIES
from hubtrace.plans.overview import profile_categories, profile_numbers, sample_top_projects
from hubtrace.plans.report import write_report_set
from hubtrace.plans.suite import run_suite

__all__ = [
    "INCIDENT_QUERIES",
    "SPECS",
    "profile_categories",
    "profile_numbers",
    "run_suite",
    "sample_top_projects",
    "write_report_set",
]

"""The construction-project star: one hub of projects, nine fact tables.

Columns are read from the tables themselves; only what names and types do not
tell is listed here.
"""

from __future__ import annotations

from hubtrace.sources.schema import TableSpec

HUB = "hub"
KEY = "ids_project_number"
_TO_HUB = {KEY: HUB}

# Roles, keys, time columns, naming exceptions, unprofiled columns.
SPECS: dict[str, TableSpec] = {
    "hub": TableSpec(primary_key=KEY),
    "project_daily": TableSpec(
        foreign_keys=_TO_HUB,
        time_col="dt_fact",
        semantic={"n_change_event_daily": "categorical"},
        unprofiled=frozenset({"cat_zip_code", "n_change_event_daily"}),
    ),
    "timecard": TableSpec(
        foreign_keys=_TO_HUB, time_col="dt_item_date", unprofiled=frozenset({"is_scd"})
    ),
    "site_log": TableSpec(
        foreign_keys=_TO_HUB,
        time_col="dt_log_date",
        semantic={"id_construction_report_logs": "numerical"},
        unprofiled=frozenset({"is_scd", "id_construction_report_logs"}),
    ),
    "observation": TableSpec(
        foreign_keys=_TO_HUB,
        time_col="dt_observation_created",
        semantic={"str_action_taken": "categorical"},
        unprofiled=frozenset({"is_scd", "str_action_taken"}),
    ),
    "task_update": TableSpec(
        foreign_keys=_TO_HUB,
        time_col="dt_effective_from",
        end_time_col="dt_effective_to",
        semantic={"cat_task_code": "ID"},
        unprofiled=frozenset({"is_scd", "cat_task_start_source", "cat_task_end_source"}),
    ),
    "hours_weekly": TableSpec(foreign_keys=_TO_HUB, time_col="dt_date"),
    "schedule_update": TableSpec(
        primary_key="cat_schedule_code",
        foreign_keys=_TO_HUB,
        time_col="dt_snapshot",
        semantic={"cat_schedule_code": "ID"},
        unprofiled=frozenset({"is_scd"}),
    ),
    "schedule_baseline": TableSpec(
        primary_key="cat_schedule_code",
        foreign_keys=_TO_HUB,
        time_col="dt_effective_from",
        end_time_col="dt_effective_to",
        semantic={"cat_schedule_code": "ID"},
        unprofiled=frozenset({"is_scd"}),
    ),
    "incident": TableSpec(
        foreign_keys=_TO_HUB,
        time_col="dt_incident_occurred",
        semantic={"pkey_columns": "categorical", "id_person_created": "categorical"},
        unprofiled=frozenset({"is_scd", "pkey_columns", "id_person_created"}),
    ),
}

TIME_COLS = {role: spec.time_col for role, spec in SPECS.items() if spec.time_col}
END_COLS = {role: spec.end_time_col for role, spec in SPECS.items() if spec.end_time_col}

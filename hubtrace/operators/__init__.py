from hubtrace.operators.band import band_join, band_rates
from hubtrace.operators.cooccur import cooccurrence, item_sets
from hubtrace.operators.graph import edges_at, fk_edges, label_table, label_windows
from hubtrace.operators.keys import check_registry, key_match, top_keys
from hubtrace.operators.latest import latest_per_key
from hubtrace.operators.percentiles import distributions
from hubtrace.operators.profile import (
    categorical_profile,
    numeric_profile,
    numeric_profiles,
    table_inventory,
    table_stats,
)
from hubtrace.operators.rates import (
    activity_density,
    burstiness,
    event_rate_by_attr,
    event_rate_by_key,
    events_per_key,
    period_overlap,
    top_k,
)
from hubtrace.operators.sample import sample_for_keys, sample_rows
from hubtrace.operators.sites import KeptSites, event_sites, id_masks

__all__ = [
    "KeptSites",
    "activity_density",
    "band_join",
    "band_rates",
    "burstiness",
    "categorical_profile",
    "check_registry",
    "cooccurrence",
    "distributions",
    "edges_at",
    "event_rate_by_attr",
    "event_rate_by_key",
    "event_sites",
    "events_per_key",
    "fk_edges",
    "id_masks",
    "item_sets",
    "key_match",
    "label_table",
    "label_windows",
    "latest_per_key",
    "numeric_profile",
    "numeric_profiles",
    "period_overlap",
    "sample_for_keys",
    "sample_rows",
    "table_inventory",
    "table_stats",
    "top_k",
    "top_keys",
]

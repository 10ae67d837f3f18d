"""Earlier names of queries: with the suffix they kept the signups in the log, as all of them do now."""

from __future__ import annotations

from clickgrain.catalog.base import ORACLES, QUERIES

SUFFIX = "_every_event"
#: Queries that never had the second name: they always read the whole log, or are newer.
ONE_NAME = {"cl15", "rc1", "rc2", "rc10", "rc11", "io9", *[f"dq{i}" for i in range(1, 9)]}
ALSO_ONE = {"ft4_monetary_of_orders", "io6_parquet_scan", "rc3_recommended_id_arrays", "rc4_true_item_lists", "io10_run_manifest", "io8_indexes_of_saved_transform", "ml9_indexes_of_training_rows", "ml10_indexes_of_inference_rows"}

_NAMED = [k for k in QUERIES if k.partition("_")[0] not in ONE_NAME and k not in ALSO_ONE]
EVERY_QUERIES = {k + SUFFIX: QUERIES[k] for k in _NAMED}
EVERY_ORACLES = {k + SUFFIX: ORACLES[k] for k in _NAMED if k in ORACLES}

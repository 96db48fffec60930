"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_preference_format
from .filters import OP11_SQL, op11_filter_audit
from .html import op5_main_text
from .jaccard import OP9_SQL, op9_jaccard_join
from .knn import OP4_SQL, op4_voronoi_join
from .lexical import OP12_SQL, op12_ranked_search
from .lm import op3_context_tree
from .mixing import OP8_SQL, op8_mixing
from .packing import op10_packing
from .pii import op13_pii
from .quality import OP6_SQL, op6_quality_rules
from .tokens import op7_token_parquet
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_preference_format": op2_preference_format,
    "op3_context_tree": op3_context_tree,
    "op4_voronoi_join": op4_voronoi_join,
    "op5_main_text": op5_main_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_parquet": op7_token_parquet,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_ranked_search": op12_ranked_search,
    "op13_pii": op13_pii,
}

ORACLE_SQL: dict[str, str] = {"op2_preference_format": OP2_SQL, "op4_voronoi_join": OP4_SQL, "op6_quality_rules": OP6_SQL, "op8_mixing": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_ranked_search": OP12_SQL}

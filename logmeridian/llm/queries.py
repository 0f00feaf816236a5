"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logmeridian.llm.bpe import op10_byte_bpe
from logmeridian.llm.coordinate_pruning import OP11_SQL, op11_hard_negatives
from logmeridian.llm.cross_polytope import op7_cross_polytope
from logmeridian.llm.dual_tree import OP13_SQL, op13_dual_tree_lloyd
from logmeridian.llm.kd_sharding import op6_kd_sharding
from logmeridian.llm.license_scan import OP12_SQL, op12_license_scan
from logmeridian.llm.line_dedup import OP8_SQL, op8_line_dedup
from logmeridian.llm.mixing import OP9_SQL, op9_mixing
from logmeridian.llm.ngram_join import op1_ngram_jaccard_join
from logmeridian.llm.pii import op2_pii
from logmeridian.llm.pitman_yor import op4_pitman_yor
from logmeridian.llm.quality import op3_quality_rules
from logmeridian.llm.warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_warc": op5_warc,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_cross_polytope": op7_cross_polytope,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_license_scan": op12_license_scan,
    "op13_dual_tree_lloyd": op13_dual_tree_lloyd,
}

ORACLE_SQL: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_dual_tree_lloyd": OP13_SQL}

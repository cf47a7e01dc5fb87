"""Registry of the queries of this subpackage and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op3_benchmark_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .language_id import op10_language_id
from .lexical_search import OP13_SQL, op13_lexical_search
from .lm_scoring import op7_lm_scoring
from .ngram_join import op9_ngram_join
from .packing import op1_best_fit_packing
from .piece_encoding import op11_piece_encoding
from .quality_classifier import op5_quality_classifier
from .secret_scan import op2_secret_scan
from .token_counts import op6_token_counts
from .url_filter import OP8_SQL, op8_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_url_filter": op8_url_filter,
    "op9_ngram_join": op9_ngram_join,
    "op10_language_id": op10_language_id,
    "op11_piece_encoding": op11_piece_encoding,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op8_url_filter": OP8_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}

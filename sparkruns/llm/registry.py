"""The corpus queries and their SQL, as ``__spark_entry__.py`` adds them."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .decontaminate import OP13_SQL, op13_benchmark_decontamination
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .nearest import op5_nearest
from .ngram_join import op9_ngram_join
from .packing import op8_packing
from .quality import op3_quality
from .spelling import OP12_SQL, op12_spelling_variants
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op4_toxicity
from .url_filter import OP6_SQL, op6_url_filter
from .wavelet import op7_token_files


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_nearest": op5_nearest,
        "op6_url_filter": op6_url_filter,
        "op7_token_files": op7_token_files,
        "op8_packing": op8_packing,
        "op9_ngram_join": op9_ngram_join,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_benchmark_decontamination": op13_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op6_url_filter": OP6_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_benchmark_decontamination": OP13_SQL,
    }

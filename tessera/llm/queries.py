"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import licenses, lines
from .ann import op6_permutation_index
from .extraction import op3_html_extraction
from .interleave import op1_media_columns
from .licenses import op7_license_scans
from .lines import op2_line_dedup
from .mixing import op4_temperature_mixing
from .neardup import op9_minhash_near_dedup
from .packing import op5_best_fit_packing
from .quality import op10_quality_classifier
from .repeats import op8_suffix_array_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_line_dedup, op3_html_extraction, op4_temperature_mixing, op5_best_fit_packing,
        op6_permutation_index, op7_license_scans, op8_suffix_array_dedup, op9_minhash_near_dedup, op10_quality_classifier,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": lines.ORACLE, "op7_license_scans": licenses.ORACLE}

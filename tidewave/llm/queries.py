"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tidewave.llm import codes, negatives
from tidewave.llm.codes import op12_part_codebooks
from tidewave.llm.extraction import op1_main_text
from tidewave.llm.fingerprints import op7_prefix_fingerprints
from tidewave.llm.neardup import op3_weighted_minhash
from tidewave.llm.negatives import op13_annulus_negatives
from tidewave.llm.ogg import op6_ogg_media
from tidewave.llm.packing import op2_best_fit_packing
from tidewave.llm.pieces import op5_sentencepiece_codec
from tidewave.llm.private import op9_disclosure_pii
from tidewave.llm.quality import op8_random_indexing_quality
from tidewave.llm.substrings import op4_repeated_passages
from tidewave.llm.suffixarrays import op11_suffix_array_family
from tidewave.llm.toxicity import op10_subsequence_kernel_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text,
        op2_best_fit_packing,
        op3_weighted_minhash,
        op4_repeated_passages,
        op5_sentencepiece_codec,
        op6_ogg_media,
        op7_prefix_fingerprints,
        op8_random_indexing_quality,
        op9_disclosure_pii,
        op10_subsequence_kernel_toxicity,
        op11_suffix_array_family,
        op12_part_codebooks,
        op13_annulus_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {"op12_part_codebooks": codes.SQL, "op13_annulus_negatives": negatives.SQL}

"""The corpus operators' registered queries and their oracles."""

from __future__ import annotations

from tidelog.llm.chunked_bpe import op4_bpe_round_trip
from tidelog.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from tidelog.llm.html_extract import op6_html_extraction
from tidelog.llm.licenses import op3_license_scan
from tidelog.llm.packing import op2_pack_sequences
from tidelog.llm.quality import OP9_SQL, op9_quality_rules
from tidelog.llm.secrets import op10_secret_scan
from tidelog.llm.simhash import op8_simhash_near_dedup
from tidelog.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from tidelog.llm.warc import OP1_SQL, op1_warc_round_trip


def queries() -> dict:
    return {
        "op1_warc_round_trip": op1_warc_round_trip,
        "op2_pack_sequences": op2_pack_sequences,
        "op3_license_scan": op3_license_scan,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict:
    return {"op1_warc_round_trip": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op7_suffix_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL}

"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from loomlog.llm import chat, decontaminate, language, licenses, packing, quality, secrets, simhash, sstable, urls

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_urls": urls.op3_urls,
    "op4_secrets": secrets.op4_secrets,
    "op5_language": language.op5_language,
    "op6_packing": packing.op6_packing,
    "op7_sstable": sstable.op7_sstable,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_licenses": licenses.op10_licenses,
}
SQL = {"op1_chat": chat.OP1_SQL, "op2_decontaminate": decontaminate.OP2_SQL, "op9_quality": quality.OP9_SQL, "op10_licenses": licenses.OP10_SQL}

"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tracewright.llm import chat, lexical_search, substring_dedup
from tracewright.llm.decontaminate import op2_decontaminate
from tracewright.llm.embedding_dedup import op10_embedding_dedup
from tracewright.llm.html_text import op6_html_text
from tracewright.llm.importance import op1_importance
from tracewright.llm.langid import op8_langid
from tracewright.llm.licenses import op4_licenses
from tracewright.llm.packing import op5_packing
from tracewright.llm.periodic_runs import op12_periodic_runs
from tracewright.llm.secrets import op9_secrets
from tracewright.llm.simhash_dedup import op7_simhash_dedup

QUERIES = {
    "op1_importance": op1_importance,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat": chat.op3_chat,
    "op4_licenses": op4_licenses,
    "op5_packing": op5_packing,
    "op6_html_text": op6_html_text,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_langid": op8_langid,
    "op9_secrets": op9_secrets,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

ORACLES: dict[str, str] = {"op3_chat": chat.ORACLE, "op11_lexical_search": lexical_search.ORACLE, "op13_substring_dedup": substring_dedup.ORACLE}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline

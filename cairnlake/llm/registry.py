"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from cairnlake.llm import decontaminate, jaccard_join, phrase_dedup, quote_linking, suffix_dedup
from cairnlake.llm.decontaminate import op6_decontamination
from cairnlake.llm.jaccard_join import op10_jaccard_join
from cairnlake.llm.phrase_dedup import op7_phrase_dedup
from cairnlake.llm.quality_rules import op3_quality_rules
from cairnlake.llm.quote_linking import op4_quote_linking
from cairnlake.llm.sentencepieces import op2_sentencepiece
from cairnlake.llm.sharding import op9_sharding
from cairnlake.llm.suffix_dedup import op8_suffix_dedup
from cairnlake.llm.toxicity import op1_toxicity
from cairnlake.llm.url_filter import op5_url_filter

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_quality_rules, op4_quote_linking, op5_url_filter, op6_decontamination, op7_phrase_dedup, op8_suffix_dedup, op9_sharding, op10_jaccard_join)}
ORACLES: dict[str, str] = {"op4_quote_linking": quote_linking.ORACLE, "op6_decontamination": decontaminate.ORACLE, "op7_phrase_dedup": phrase_dedup.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE}

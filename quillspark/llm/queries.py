"""The registered queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from . import interval_join, lexical_search, mixing
from .bpe_rounds import op11_bpe_rounds
from .byte_bpe import op4_byte_bpe
from .html_extract import op7_html_extract
from .interval_join import op12_interval_join
from .lexical_search import op13_lexical_search
from .media import op3_media
from .mixing import op9_mixing
from .ngram_join import op5_ngram_join
from .quality_ranking import op10_quality_ranking
from .quality_rules import op8_quality_rules
from .sharding import op6_sharding
from .token_ids import op1_token_ids
from .toxicity import op2_toxicity

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_toxicity": op2_toxicity,
    "op3_media": op3_media,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_sharding": op6_sharding,
    "op7_html_extract": op7_html_extract,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_quality_ranking": op10_quality_ranking,
    "op11_bpe_rounds": op11_bpe_rounds,
    "op12_interval_join": op12_interval_join,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {"op9_mixing": mixing.ORACLE, "op12_interval_join": interval_join.ORACLE, "op13_lexical_search": lexical_search.ORACLE}

"""The registered queries of these operators and, where SQL can express one, their SQL."""

from __future__ import annotations

from .bpe_replay import op7_bpe_replay
from .chat_format import OP6_SQL, op6_chat_format
from .common import ship
from .cube_mix import op10_cube_mix
from .minhash_join import op9_minhash_join
from .ogg_media import op4_ogg_media
from .quality_classifier import op1_quality_classifier
from .quality_rules import op2_quality_rules
from .secret_scan import op5_secret_scan
from .suffix_dedup import op8_suffix_dedup
from .token_arrow import op3_token_arrow

_ALL = (op1_quality_classifier, op2_quality_rules, op3_token_arrow, op4_ogg_media, op5_secret_scan, op6_chat_format, op7_bpe_replay, op8_suffix_dedup, op9_minhash_join, op10_cube_mix)


def _shipped(f):
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    query.__doc__ = f.__doc__
    return query


def queries() -> dict:
    return {f.__name__: _shipped(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": OP6_SQL}

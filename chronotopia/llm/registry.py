"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .align import op11_align
from .ann import op7_ann
from .bpe import op4_bpe
from .embed_dedup import ORACLE as EMBED_SQL
from .embed_dedup import op5_embed_dedup
from .html_text import op13_html
from .langid import op2_langid
from .mixing import op3_mixing
from .pii import op6_pii
from .resample import op12_resample
from .resample_sql import ORACLE as RESAMPLE_SQL
from .secrets import op1_secrets
from .secrets_sql import ORACLE as SECRETS_SQL
from .sharding import op10_sharding
from .simhash import op9_simhash
from .suffix_dedup import op8_suffix_dedup

QUERIES = {"op1_secrets": op1_secrets, "op2_langid": op2_langid, "op3_mixing": op3_mixing, "op4_bpe": op4_bpe, "op5_embed_dedup": op5_embed_dedup, "op6_pii": op6_pii, "op7_ann": op7_ann, "op8_suffix_dedup": op8_suffix_dedup, "op9_simhash": op9_simhash, "op10_sharding": op10_sharding, "op11_align": op11_align, "op12_resample": op12_resample, "op13_html": op13_html}
ORACLES: dict[str, str] = {"op1_secrets": SECRETS_SQL, "op5_embed_dedup": EMBED_SQL, "op12_resample": RESAMPLE_SQL}

"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from .languages import op12_languages
from .mixing import SQL as MIXING
from .mixing import op7_mixing
from .neighbours import SQL as NEIGHBOURS
from .neighbours import op6_neighbours
from .pieces import op8_pieces
from .quality import op1_quality
from .repeats import SQL as REPEATS
from .repeats import op3_repeats
from .rules import op9_rules
from .runs import op13_runs
from .secrets import op4_secrets
from .secrets import oracle as secrets_sql
from .simhash import op10_simhash
from .toxicity import op2_toxicity
from .whitening import op11_whitening
from .wrapper import op5_wrapper

QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_repeats": op3_repeats,
    "op4_secrets": op4_secrets,
    "op5_wrapper": op5_wrapper,
    "op6_neighbours": op6_neighbours,
    "op7_mixing": op7_mixing,
    "op8_pieces": op8_pieces,
    "op9_rules": op9_rules,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_languages": op12_languages,
    "op13_runs": op13_runs,
}

SQL: dict[str, str] = {
    "op3_repeats": REPEATS,
    "op4_secrets": secrets_sql(),
    "op6_neighbours": NEIGHBOURS,
    "op7_mixing": MIXING,
}

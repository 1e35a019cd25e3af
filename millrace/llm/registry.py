"""The queries of this folder by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from . import ranked, warc
from .alignment import op12_alignment
from .extraction import op5_extraction
from .fingerprints import op4_fingerprints
from .licenses import op8_licenses
from .mixing import op6_mixing
from .neardup import op9_neardup
from .neighbours import op7_neighbours
from .pieces import op3_pieces
from .quality import op2_quality
from .ranked import op11_ranked
from .simhash import op13_simhash
from .toxicity import op10_toxicity
from .warc import op1_warc


def pipeline(spark, sf_dir):
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality, op3_pieces, op4_fingerprints, op5_extraction, op6_mixing, op7_neighbours, op8_licenses, op9_neardup, op10_toxicity, op11_ranked, op12_alignment, op13_simhash, pipeline)}
ORACLE_SQL: dict[str, str] = {"op1_warc": warc.ORACLE_SQL, "op11_ranked": ranked.ORACLE_SQL}

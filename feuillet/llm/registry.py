"""The queries of this subpackage by name, and SQL for those that SQL can state on whole tables."""

from __future__ import annotations

from . import backoff, divergence, walshcodes
from .backoff import op3_stupid_backoff
from .chosenpath import op4_chosen_path
from .divergence import op13_source_audit
from .kmeanstree import op2_kmeans_tree
from .languages import op12_naive_bayes
from .packing import op8_packing
from .pcatiles import op9_pca_tiles
from .pieces import op6_pieces
from .pii import op10_pii
from .tokencounts import op5_token_counts
from .toxicity import op1_toxicity
from .transcripts import op7_transcripts
from .walshcodes import op11_walsh_codes

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_kmeans_tree, op3_stupid_backoff, op4_chosen_path, op5_token_counts, op6_pieces, op7_transcripts, op8_packing, op9_pca_tiles, op10_pii, op11_walsh_codes, op12_naive_bayes, op13_source_audit)}
ORACLES = {"op3_stupid_backoff": backoff.ORACLE, "op11_walsh_codes": walshcodes.ORACLE, "op13_source_audit": divergence.ORACLE}

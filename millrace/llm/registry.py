"""Queries of this subpackage, by the names under which they are registered, and their SQL where it can say them."""

from .html_text import op2_html_text
from .katz import op7_katz
from .knn_join import OP10_SQL, op10_voronoi_knn
from .minhash import OP8_SQL, op8_bottom_k
from .mixing import op1_mix_sources
from .packing import op5_best_fit_packing
from .quality import op9_quality
from .range_join import OP4_SQL, op4_near_vectors
from .sharding import op6_label_propagation
from .warc import OP3_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_html_text, op3_warc, op4_near_vectors, op5_best_fit_packing, op6_label_propagation, op7_katz, op8_bottom_k, op9_quality, op10_voronoi_knn)}
SQL = {"op3_warc": OP3_SQL, "op4_near_vectors": OP4_SQL, "op8_bottom_k": OP8_SQL, "op10_voronoi_knn": OP10_SQL}

"""The corpus operators' queries and their SQL, for __spark_entry__."""

from .centroids import OP11_SQL, op11_block_norms
from .classlm import op5_brown_classes
from .decontaminate import op1_spaced_seeds
from .langid import op3_subword_softmax
from .licenses import OP13_SQL, op13_license_rules
from .minmax import op10_minmax_near
from .mixing import op7_sainte_lague
from .quality import OP4_SQL, op4_quality_hosts
from .runs import op12_periodic_runs
from .sharding import op8_kd_shards
from .tokencount import op6_pretoken_counts
from .toxicity import op2_nearest_toxic
from .urlfilter import OP9_SQL, op9_bloom_cascade

QUERIES = {f.__name__: f for f in (op1_spaced_seeds, op2_nearest_toxic, op3_subword_softmax, op4_quality_hosts, op5_brown_classes, op6_pretoken_counts, op7_sainte_lague, op8_kd_shards, op9_bloom_cascade, op10_minmax_near, op11_block_norms, op12_periodic_runs, op13_license_rules)}
ORACLES = {"op4_quality_hosts": OP4_SQL, "op9_bloom_cascade": OP9_SQL, "op11_block_norms": OP11_SQL, "op13_license_rules": OP13_SQL}

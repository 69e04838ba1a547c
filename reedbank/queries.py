"""All engine queries over the driver's tables, and their SQL."""

from reedbank.plans import q_assign, q_chimera, q_kernel, q_likelihood, q_mixture, q_msa, q_otu, q_pattern, q_seq, q_tree  # noqa: F401  modules register their queries
from reedbank.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

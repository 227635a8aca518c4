"""The subpackage's registered queries and their SQL."""

from . import alignment, collocations, decontaminate, licenses, linededup, neardup, packing, pii, quality, secrets, suffixdedup, tokenbin, topk

MODULES = (topk, quality, secrets, licenses, decontaminate, neardup, tokenbin, suffixdedup, pii, packing, linededup, collocations, alignment)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in MODULES for k, f in m.ORACLES.items()}

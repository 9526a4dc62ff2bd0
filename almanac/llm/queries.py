"""Registers the queries of all operators of this subpackage."""

from almanac.llm import (  # noqa: F401
    exact_dedup, language_id, licenses, mixing, neighbours, ngram_join, packing, quality, secrets, sharding, spelling, toxicity, whitening)
from almanac.llm.common import BOOK  # noqa: F401

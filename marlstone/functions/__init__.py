"""Scalar functions on columns, in one place."""

from marlstone.operators.entities import base_symbol, lead_days, normal_address, sector_of, trigram_similarity, trigrams  # noqa: F401
from marlstone.operators.flows import bucket  # noqa: F401
from marlstone.operators.keyed import content_hash  # noqa: F401
from marlstone.operators.links import absolute, classify, host_of, hrefs, is_spa, normal_url, page_text  # noqa: F401
from marlstone.operators.market import tier  # noqa: F401
from marlstone.operators.research import post_type, to_alert, valid_citations  # noqa: F401

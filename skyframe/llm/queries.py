"""The queries of this subpackage: importing this module registers all of them."""

from skyframe.llm import ann, chat, divergence, exact_dedup, html_text, licenses, mixing, near_dedup, packing, prefix_trie, quality, suffix_dedup, url_filter  # noqa: F401
from skyframe.llm.common import ORACLES, QUERIES  # noqa: F401

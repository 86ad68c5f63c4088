"""The corpus queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from wattaudit.llm.clustering import CLUSTER_SQL
from wattaudit.llm.decontaminate import CONTAMINATED_SQL
from wattaudit.llm.mixing import MIX_SQL
from wattaudit.llm.trie import TRIE_SQL
from wattaudit.llm.warc import WARC_SQL

ORACLE: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op9_mix_sources": MIX_SQL,
    "op11_decontamination": CONTAMINATED_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_centroids": CLUSTER_SQL,
}

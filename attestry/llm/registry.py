"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from attestry.llm.ann import op1_nearest
from attestry.llm.bpe_codec import op10_bpe
from attestry.llm.conversations import op12_repair
from attestry.llm.html_text import op8_html_text
from attestry.llm.line_dedup import op5_line_dedup
from attestry.llm.merkle import OP11_SQL, op11_manifest
from attestry.llm.mips import OP4_SQL, op4_inner_products
from attestry.llm.packing import op2_packing
from attestry.llm.revisits import OP7_SQL, op7_revisits
from attestry.llm.simhash import op3_simhash
from attestry.llm.token_files import op9_token_files
from attestry.llm.toxicity import op6_toxicity
from attestry.llm.url_rules import OP13_SQL, op13_url_rules

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_inner_products": op4_inner_products,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_revisits": op7_revisits,
    "op8_html_text": op8_html_text,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_manifest": op11_manifest,
    "op12_repair": op12_repair,
    "op13_url_rules": op13_url_rules,
}

#: DuckDB SQL, where SQL can express a query.
ORACLES: dict[str, str] = {
    "op4_inner_products": OP4_SQL,
    "op7_revisits": OP7_SQL,
    "op11_manifest": OP11_SQL,
    "op13_url_rules": OP13_SQL,
}

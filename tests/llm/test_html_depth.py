"""An end tag finds its start however many unclosed elements lie between."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ferrule.llm import html_crf


@pytest.mark.parametrize("tag", ["span", "font", "div"])
@pytest.mark.parametrize("n", [3, 65, 500])
def test_article_ends(tag, n):
    page = "<html><body><article><p>Some text of the article.</p>" + f"<{tag}>" * n + "inside</article><footer>A footer.</footer></body></html>"
    blocks = html_crf.leaf_blocks(page)
    assert len(blocks) == 3 and "in:article" in blocks[0].features and "in:article" in blocks[1].features
    assert "in:article" not in blocks[2].features and "in:footer" in blocks[2].features

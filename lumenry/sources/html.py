"""HTML pages to text blocks with sections: the standard library's parser in Arrow batches, Spark for the rest."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.operators import chunking

# Elements left out, elements that are blocks, blocks that set the section.
SKIPPED = frozenset(("script", "style", "noscript", "nav", "header", "footer", "iframe"))
BLOCKS = frozenset(("h1", "h2", "h3", "h4", "p", "li", "td", "pre", "blockquote"))
SECTIONS = frozenset(("h1", "h2", "h3"))
FEW, WIDTH = 200, 1800

SCHEMA = "array<struct<section:string,text:string>>"


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.blocks: list[tuple[str, str]] = []
        self.all: list[str] = []
        self.skipping = 0
        self.in_title = False
        self.title = self.section = ""

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in SKIPPED
        self.in_title = tag == "title"
        if tag in BLOCKS:
            self.open.append([tag, [], len(self.blocks)])
            self.blocks.append(("", ""))

    def handle_endtag(self, tag):
        self.skipping = max(0, self.skipping - (tag in SKIPPED))
        self.in_title = False
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(self.open.pop(k))
                break

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipping:
            self.all.append(data)
            for block in self.open:
                block[1].append(data)

    def _close(self, block):
        tag, data, at = block
        text = " ".join(" ".join(data).split())  # pieces of inner elements are words apart
        if tag in SECTIONS:
            self.section = text or self.section
        elif text:
            self.blocks[at] = (self.section, text)

    def result(self) -> list[dict]:
        for block in self.open[::-1]:
            self._close(block)
        title = " ".join(self.title.split())
        out = [{"section": s or title, "text": t} for s, t in self.blocks if t]
        if sum(len(b["text"]) for b in out) < FEW:
            lines = (" ".join(x.split()) for x in "".join(self.all).split("\n"))
            out = [{"section": title, "text": x} for x in lines if x]
        return out


def parse(html: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.result()


def pack(blocks: list[dict], width: int = WIDTH) -> list[dict]:
    """Neighbouring blocks of one section joined up to ``width`` characters."""
    out: list[dict] = []
    for b in blocks:
        if out and out[-1]["section"] == b["section"] and len(out[-1]["text"]) + 1 + len(b["text"]) <= width:
            out[-1] = {"section": b["section"], "text": f"{out[-1]['text']}\n{b['text']}"}
        else:
            out.append(dict(b))
    return out


def packed_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, k, w, section, text, char_count): a row for each window of every packed block of every page."""
    @F.pandas_udf(SCHEMA)
    def blocks_of(html: pd.Series) -> pd.Series:
        return html.map(lambda x: pack(parse(x)))

    rows = pages.select("page_id", F.posexplode(blocks_of("html")).alias("k", "b")).select("page_id", "k", "b.section", F.col("b.text").alias("t"))
    # a block over the width is cut into windows
    cut = F.transform(chunking.windows(F.col("t")), lambda s: F.struct(s.alias("start"), T.strip(F.col("t").substr(s + 1, F.lit(WIDTH))).alias("text")))
    rows = rows.select("page_id", "k", "section", F.posexplode(cut).alias("w", "x")).where("x.text <> ''")
    return rows.select("page_id", "k", "w", "section", "x.text", F.length("x.text").alias("char_count"))

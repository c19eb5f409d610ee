"""Raw files (path, content) to parsed documents: which file a document is, how its bytes are read, what of it fails, and what was parsed before.

Files are rows as ``spark.read.format("binaryFile")`` gives them, or any table with a path and a binary content.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.operators import chunking
from lumenry.sources import html as H

#: Encodings tried in this order; the first, with or without its mark, is told by Spark, the other by Python for those bytes only that the first doesn't fit.
ENCODINGS = ("utf-8", "gb18030")
# Fixed value: beginnings of lines that are headings.
HEADING = r"(?:第[一二三四五六七八九十百千0-9０-９]+[章节条编]|附则|附件|目录|总则)"
SHORTEST = 20

# ---------------------------------------------------------------- which file


def names(files: DataFrame) -> DataFrame:
    """(path, folder, stem, suffix) of files."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    dot = F.length(name) - F.length(F.regexp_extract(name, r"(\.[^.]*)\z", 1))
    own = files.select("path", F.regexp_replace("path", r"/[^/]*\z", "").alias("folder"), F.substr(name, F.lit(1), dot).alias("stem"), F.substr(name, dot + 1).alias("suffix"))
    return own


def resolve(wanted: DataFrame, files: DataFrame, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """(domain, doc_id, path, n_hits, error): the one file of every wanted (domain, doc_id); none or several are an error, never a choice.

    A rule is (domain, pattern of doc_ids, folder, suffix, how): ``exact`` takes the doc_id as the file's stem with just this suffix, ``any_case`` the suffix in any case, ``prefix`` the
    pattern's first group as the beginning of the stem before an underscore. The first rule that fits counts. Files are indexed by each of these, a stem by all its beginnings, so every rule is an equality.
    Repeated rows of wanted are one."""
    spark = wanted.sparkSession
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "i int, r_domain string, pattern string, folder string, suffix string, how string")
    own = wanted.select("domain", F.col("doc_id").cast("string").alias("doc_id")).distinct()
    on = (F.col("domain") == F.col("r_domain")) & F.expr("doc_id RLIKE pattern")
    lead = F.when(F.col("how") == "prefix", F.expr("regexp_extract(doc_id, pattern, 1)"))
    rule = F.min(F.when(F.col("i").isNotNull(), F.struct("i", "folder", "suffix", "how", lead.alias("lead"))))
    grouped = own.join(F.broadcast(listed), on, "left").groupBy("domain", "doc_id").agg(rule.alias("rule"))
    known = [r[0] for r in rules]
    asked = grouped.select("domain", "doc_id", "rule", F.when(F.col("rule.how") == "prefix", F.col("rule.lead")).otherwise(F.col("doc_id")).alias("key"), F.col("rule.how").alias("how"), F.col("rule.folder").alias("folder"), F.col("rule.suffix").alias("suffix"))
    file = names(files)
    parts = F.split("stem", "_")
    leads = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), "_"))), lambda x: x.isNotNull())
    index = file.select("path", "folder", F.explode(F.concat(
        F.array(F.struct(F.lit("exact").alias("how"), F.col("stem").alias("key"), F.col("suffix").alias("suffix")), F.struct(F.lit("any_case").alias("how"), F.col("stem").alias("key"), F.lower("suffix").alias("suffix"))),
        F.transform(leads, lambda x: F.struct(F.lit("prefix").alias("how"), x.alias("key"), F.col("suffix").alias("suffix"))),
    )).alias("x")).select("path", "folder", "x.*")
    hits = asked.join(index, ["folder", "how", "key", "suffix"], "left").groupBy("domain", "doc_id").agg(F.count("path").alias("n_hits"), F.min("path").alias("path"), F.bool_or(F.col("rule").isNull()).alias("no_rule"))
    error = F.when(~F.coalesce(F.col("domain").isin(*known), F.lit(False)), "unknown_domain").when(F.col("no_rule"), "unknown_name").when(F.col("n_hits") == 0, "not_found").when(F.col("n_hits") > 1, "ambiguous")
    return hits.select("domain", "doc_id", F.when(F.col("n_hits") == 1, F.col("path")).alias("path"), "n_hits", error.alias("error"))


# ---------------------------------------------------------------- how bytes are read


def _other_encoding(content: pd.Series) -> pd.Series:
    def read(data):
        try:
            return None if data is None else bytes(data).decode(ENCODINGS[1])
        except UnicodeDecodeError:
            return None

    return content.map(read)


def decoded(rows: DataFrame, content: str = "content") -> DataFrame:
    """The rows with ``text`` and ``encoding``, both null where no encoding fits. A byte-order mark goes; line ends become newlines."""
    raw = F.col(content)
    marked = F.hex(F.substring(raw, 1, 3)) == "EFBBBF"
    body = F.when(marked, F.substr(raw, F.lit(4))).otherwise(raw).cast("string")
    own = rows.withColumn("_valid", F.coalesce(F.is_valid_utf8(body), F.lit(False)))
    other = own.withColumn("_other", F.pandas_udf(_other_encoding, "string")(F.when(~F.col("_valid"), raw)))
    text = F.when(F.col("_valid"), body).otherwise(F.col("_other"))
    encoding = F.when(F.col("_valid"), ENCODINGS[0]).when(F.col("_other").isNotNull(), ENCODINGS[1])
    return other.withColumn("text", F.regexp_replace(text, "\r\n?", "\n")).withColumn("encoding", encoding).drop("_valid", "_other")


def _pages_apart(content: pd.Series) -> pd.Series:
    def page(data: bytes):
        for encoding in ("utf-8-sig", *ENCODINGS):
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(lambda data: None if data is None else [page(p) for p in bytes(data).split(b"\f")])


# ---------------------------------------------------------------- what is in them


def blocks_of_text(text: Column) -> Column:
    """Blocks (section, text) of a plain text: by heading lines if it has any, else by paragraphs."""
    parts = F.split(text, rf"(?m)(?=^[ \t]*{HEADING})")
    by_heading = F.transform(parts, lambda p: F.struct(F.when(p.rlike(rf"\A[ \t]*{HEADING}"), T.strip(F.regexp_extract(p, r"\A([^\n]*)", 1))).otherwise("").alias("section"), T.strip(p).alias("text")))
    by_paragraph = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.struct(F.lit("").alias("section"), T.strip(p).alias("text")))
    found = F.when(text.rlike(rf"(?m)^[ \t]*{HEADING}"), by_heading).otherwise(by_paragraph)
    return F.filter(found, lambda b: b["text"] != "")


def _kept(pieces: Column) -> Column:
    return F.filter(pieces, lambda c: (F.length(c["text"]) >= SHORTEST) | c["text"].rlike(rf"\A{HEADING}"))


def _pieces(page: Column, section: Column, text: Column) -> Column:
    """The windows of a text that aren't blank. The text is bound to a name, so that it is made once and not for each window."""
    cut = lambda t: F.transform(chunking.windows(t), lambda s, i: F.struct(page.alias("page"), section.alias("section"), i.alias("k"), T.strip(t.substr(s + 1, F.lit(chunking.WIDTH))).alias("text")))
    return F.filter(F.flatten(F.transform(F.array(text), cut)), lambda c: c["text"] != "")


def parse(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, chunks, failures), a row a document, in one pass. docs: (doc_id, kind, content), kind one of html, txt and paged (pages apart by form feeds).

    Nothing stops the run: a document whose bytes fit no encoding, or whose kind isn't known, is a failure of stage ``document``, a page of a paged one a failure of stage ``page_<n>`` while its
    other pages stay. A null content is a failure. A chunk is (page, section, k, text); k counts a page's windows, or all chunks of the document elsewhere."""
    paged = F.col("kind") == "paged"
    own = decoded(docs.select("doc_id", "kind", F.when(paged, None).otherwise(F.col("content")).alias("content"), F.when(paged, F.col("content")).alias("paged")))
    own = own.withColumn("pages", F.pandas_udf(_pages_apart, "array<string>")("paged"))
    html = own.withColumn("blocks", F.pandas_udf(_html_blocks, H.SCHEMA)(F.when(F.col("kind") == "html", F.col("text"))))
    blocks = F.when(F.col("kind") == "html", F.col("blocks")).when(F.col("kind") == "txt", blocks_of_text(F.col("text")))
    flat = _kept(F.flatten(F.transform(F.coalesce(blocks, F.array().cast(H.SCHEMA)), lambda b: _pieces(F.lit(None).cast("int"), b["section"], T.strip(b["text"])))))
    numbered = F.transform(flat, lambda c, i: c.withField("k", i))
    page_text = lambda p: T.strip(chunking.merge_character_lines(p))
    by_page = F.flatten(F.transform(F.filter(F.transform("pages", lambda p, i: F.struct((i + 1).alias("n"), p.alias("p"))), lambda x: x["p"].isNotNull()), lambda x: _kept(_pieces(x["n"], F.lit(""), page_text(x["p"])))))
    failed_pages = F.filter(F.transform("pages", lambda p, i: F.when(p.isNull(), F.struct(F.concat(F.lit("page_"), (i + 1).cast("string")).alias("stage"), F.lit("encoding").alias("error")))), lambda x: x.isNotNull())
    bad = F.when(~F.coalesce(F.col("kind").isin("html", "txt", "paged"), F.lit(False)), "kind").when(F.coalesce("content", "paged").isNull(), "content").when(~paged & F.col("text").isNull(), "encoding")
    none = F.array().cast("array<struct<stage:string,error:string>>")
    failures = F.when(bad.isNotNull(), F.array(F.struct(F.lit("document").alias("stage"), bad.alias("error")))).when(paged, failed_pages).otherwise(none)
    chunks = F.when(bad.isNotNull(), F.array().cast("array<struct<page:int,section:string,k:int,text:string>>")).when(paged, by_page).otherwise(numbered)
    return html.select("doc_id", "kind", chunks.alias("chunks"), failures.alias("failures"))


def _html_blocks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else H.pack(H.parse(t)))


def counters() -> list[Column]:
    """What is counted while documents are written."""
    failed = F.exists("failures", lambda f: f["stage"] == "document")
    return [
        F.count("*").alias("documents"),
        F.count_if(failed).alias("failed_documents"),
        F.coalesce(F.sum(F.size(F.filter("failures", lambda f: f["stage"] != "document"))), F.lit(0)).alias("failed_pages"),
        F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"),
    ]


# ---------------------------------------------------------------- what was parsed before


class ParseCache:
    """Parsed documents in a folder: each run adds a batch of those that are not there yet.

    A document is known by its id, kind and the SHA-256 of its content; a changed one is parsed again. A batch is written beside the others and gets its number by one rename,
    so readers see all of it or nothing, and a run that fails leaves nothing that counts. The latest batch of a document holds. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def batches(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n.removeprefix("batch=")) for n in found if n.startswith("batch="))

    def read(self) -> DataFrame | None:
        """(doc_id, kind, sha, chunks, failures, batch) of every document as last parsed; null before the first batch."""
        if not self.batches():
            return None
        every = self.spark.read.option("basePath", self.folder).parquet(*(f"{self.folder}/batch={b}" for b in self.batches()))
        if len(self.batches()) == 1:
            return every
        latest = every.groupBy("doc_id").agg(F.max("batch").alias("batch"))  # ids only
        return every.join(latest, ["doc_id", "batch"], "left_semi")

    def update(self, docs: DataFrame, refresh: DataFrame | str | None = None) -> dict[str, int]:
        """Parse what is new or changed of docs (doc_id, kind, content), and what ``refresh`` asks for (a table of doc_ids, or "all"); the counts of this run."""
        own = docs.withColumn("sha", F.sha2("content", 256))
        known, todo = self.read(), own
        if known is not None and not (isinstance(refresh, str) and refresh == "all"):
            same = known.select("doc_id", F.col("kind").alias("_kind"), F.col("sha").alias("_sha"))
            if refresh is not None:
                same = same.join(refresh.select("doc_id").distinct(), "doc_id", "left_anti")
            equal = (F.col("o.doc_id") == F.col("s.doc_id")) & F.col("o.kind").eqNullSafe(F.col("s._kind")) & F.col("o.sha").eqNullSafe(F.col("s._sha"))
            todo = own.alias("o").join(same.alias("s"), equal, "left_anti")
        seen = Observation(f"parse-{uuid.uuid4().hex}")
        shas = todo.withColumn("doc_id", F.struct("doc_id", "sha"))
        parsed = parse(shas).select(F.col("doc_id.doc_id").alias("doc_id"), "kind", F.col("doc_id.sha").alias("sha"), "chunks", "failures")
        parsed = parsed.observe(seen, *counters())
        loose = f"_{uuid.uuid4().hex}"
        parsed.write.parquet(f"{self.folder}/{loose}")
        counts = {k: int(v) for k, v in seen.get.items()}
        if not counts["documents"]:
            self._fs.delete(self._path(loose), True)
            return counts
        name = f"batch={max(self.batches(), default=0) + 1}"
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(loose), self._path(name)):
            raise RuntimeError(f"{name} of {self.folder} was written meanwhile")
        return counts

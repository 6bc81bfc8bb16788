"""Main texts of pages, by differences from the page of the nearest URL."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_nothing, rows_with_text, stored
from .html_lines import PLAIN, chosen, lines_of, shared_lines

RECORD = "host string, path string, url string, page string, hashes array<long>, own array<int>"


class Page(NamedTuple):
    """A page as it stands in order: its lines' hashes, and which of them are of the part that its main text is taken from."""

    host: str
    path: str
    url: str
    page: str
    hashes: list[int]
    own: list[int]


def page_key(url: str, html: str) -> Column:
    """Tells pages of different URLs or contents apart."""
    return F.md5(F.concat_ws("\0", F.coalesce(F.col(url).cast("string"), F.lit("")), F.coalesce(F.col(html).cast("string"), F.lit(""))))


def gone_of(page: Page, before: Page | None, after: Page | None) -> list[int]:
    """The page's lines that the page of the nearest URL shares, whatever their marks.

    That is the neighbour on the same host with the longer common beginning of the path, the one before if both are as
    near. A page of whose own part no line would be left is a copy of the other, and none of that part's lines go.
    """
    near = [p for p in (before, after) if p and p.host == page.host]
    if not near:
        return []
    other = max(near, key=lambda p: len(commonprefix([p.path, page.path])))
    gone, own = set(shared_lines(page.hashes, other.hashes)), set(page.own)
    return sorted(gone - own if own <= gone else gone)


def neighbours(pages: Iterable[Page]) -> Iterator[tuple[Page | None, Page, Page | None]]:
    """Each of the pages, which come in order, between those next to it."""
    before = here = None
    for after in pages:
        if here:
            yield before, here, after
        before, here = here, after
    if here:
        yield before, here, None


def template_lines(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``page`` and ``gone``: of pages that share lines with the page of the nearest URL, the numbers of these lines.

    Every page is aligned, with all of its lines, marked or not. Pages are sorted by host and path; the nearest is next to a page. Rows hold hashes of lines, not texts. The first and last pages
    of each range, whose neighbours lie in others, are put in order once more: four rows at most of each range.
    """
    rest = F.regexp_extract(F.col(url).cast("string"), r"(?s)^.*?://(.*)$", 1)
    host, path = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    texts = pages.where(F.col(html).isNotNull() & F.col(url).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(url).cast("string").alias("url"), page_key(url, html).alias("page"), F.col(html).cast("string").alias("html"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            hashes, own = [], []
            for page in batch.column("html"):
                lines = lines_of(page.as_py())
                part = chosen(lines)
                hashes.append([xxhash.xxh64_intdigest(line) - (1 << 63) for _, line in lines])
                own.append([k for k, (of, _) in enumerate(lines) if of == part])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("host", "path", "url", "page")], pa.array(hashes, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int32()))], ["host", "path", "url", "page", "hashes", "own"])

    order = ["host", "path", "url", "page"]
    known = texts.mapInArrow(parsed, RECORD).where("host <> ''").groupBy(*order).agg(F.first("hashes").alias("hashes"), F.first("own").alias("own"))
    records = stored(known, "lines")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
        for batch in batches:
            yield from (Page(**row) for row in batch.select(Page._fields).to_pylist())

    def row_of(page: Page, gone: list[int], edge: bool, asks: bool) -> dict:
        return {**page._asdict(), "gone": gone, "edge": edge, "asks": asks}

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines that go, and the pages at both ends of the range."""
        keep_nothing()
        last: list[Page] = []
        for n, (before, page, after) in enumerate(neighbours(read(batches))):
            out = []
            if before and after and (gone := gone_of(page, before, after)):
                out.append(row_of(page._replace(hashes=[], own=[]), gone, False, False))
            if n < 2:
                out.append(row_of(page, [], True, n == 0))
            last = [*last[-1:], page]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist([row_of(page, [], True, page is last[-1]) for page in last], schema)

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple[Page, bool]]:
            held: list = []
            for batch in batches:
                for row in batch.to_pylist():
                    page = Page(**{c: row[c] for c in Page._fields})
                    if held and held[0].page == page.page and held[0].url == page.url:
                        held[1] |= row["asks"]
                        continue
                    if held:
                        yield held[0], held[1]
                    held = [page, row["asks"]]
            if held:
                yield held[0], held[1]

        asking: dict[str, bool] = {}

        def noted() -> Iterator[Page]:
            for page, asks in whole():
                asking[page.page] = asks
                yield page

        for before, page, after in neighbours(noted()):
            if asking.pop(page.page) and (gone := gone_of(page, before, after)):
                yield pa.RecordBatch.from_pylist([{"page": page.page, "gone": gone}], pa.schema([("page", pa.string()), ("gone", pa.list_(pa.int32()))]))

    fields = [*[(c, pa.string()) for c in order], ("hashes", pa.list_(pa.int64())), ("own", pa.list_(pa.int32())), ("gone", pa.list_(pa.int32())), ("edge", pa.bool_()), ("asks", pa.bool_())]
    schema = pa.schema(fields)
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(aligned, RECORD + ", gone array<int>, edge boolean, asks boolean"), "aligned")
    edges = found.where("edge").drop("gone", "edge").coalesce(1).sortWithinPartitions(*order)
    return found.where("not edge").select("page", "gone").unionAll(edges.mapInArrow(mended, "page string, gone array<int>"))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The main text of every page: id, columns to keep, url, text, n_chars, n_shared, n_returned.

    A page is a list of lines: the text of each block, in order. It is paired with the page of its host whose path has the longest
    beginning in common with its own, both lists are aligned by a longest common subsequence, and shared lines
    go (``n_shared``). Then the markup checks what is left. Shared lines come back (``n_returned``) if they are the article's: the texts of ``article`` elements, of the ``main`` element if there
    is no article, are whole, as articles of two pages may share passages or be copies. What the markup
    says is no article goes as well, shared or not: navigation, headers (but an article's own), footers, asides, forms,
    dialogs, scripts, styles, and elements whose class, id or role names an advert, notice, menu, sidebar or comments. Of pages
    without such marks the method alone decides.

    References are decoded as HTML 5 has them; white space is any that Unicode knows; lines are joined by one space. A null or empty page has
    an empty text. Pages without a URL, without a host or alone on their host share nothing. Rows that repeat URL and
    page have one text. A page whose unmarked lines are all shared is a copy, and keeps them. Without rows the result is empty.
    """
    gone = stored(template_lines(pages, url, html), "template-lines")
    texts, name = rows_with_text(pages, page_id, html, keep, __url=F.col(url), __page=page_key(url, html))
    if gone.head(1):
        texts = texts.join(gone.select(F.col("page").alias("__page"), F.col("gone").alias("__gone")), "__page", "left").drop("__page")
    else:
        texts = texts.withColumn("__gone", F.lit(None).cast("array<int>")).drop("__page")
    columns, counts = [page_id, *keep], ["__size", "__shared", "__returned"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            found, shared, returned = [], [], []
            for page, gone_lines in zip(batch.column(name), batch.column("__gone"), strict=True):
                lines, gone = lines_of(page.as_py() or ""), set(gone_lines.as_py() or ())
                part = chosen(lines)
                back = {k for k in gone if lines[k][0] == part != PLAIN}
                found.append(" ".join(line for k, (of, line) in enumerate(lines) if of == part and (k not in gone or k in back)))
                shared.append(len(gone))
                returned.append(len(back))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], batch.column("__url"), pa.array(found, pa.string()), *[pa.array(n, pa.int64()) for n in (map(len, found), shared, returned)]], [*columns, "__url", "__main", *counts])

    schema = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns], f"__url {pages.schema[url].dataType.simpleString()}", "__main string", *[f"{c} long" for c in counts]])
    return texts.mapInArrow(made, schema).select(*columns, F.col("__url").alias("url"), F.col("__main").alias("text"), F.col("__size").alias("n_chars"), F.col("__shared").alias("n_shared"), F.col("__returned").alias("n_returned"))

"""Main text of HTML pages by boosted trees over block elements.

Each block element gets features of its tags, attribute tokens, subtree density,
depth and siblings; boosted trees give the odds that it belongs to the main text.
Decoding chooses the likeliest consistent set: what is kept lies in kept elements
only, and a dropped element takes all below it along. The trees are fitted on pages
with known parts, put together here from texts of the corpus in many layouts.
"""

from __future__ import annotations

import random
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm import boosting
from gridcast.llm.frames import arrow_pass, hash_share
from gridcast.llm.html_dom import decode, features, read, text_of
from gridcast.plans.storage import materialize

#: Texts that training pages are made of: a share of the rows by the hash of the text.
SAMPLE_TEXTS = 600
SAMPLE_CHARS = 6000


class _Maker:
    """One labelled page: elements of the main text and those around them have the label 1."""

    def __init__(self, seed: int, texts: list[str]):
        self.rng = random.Random(seed)
        self.words = [w for t in texts for w in t.split()] or ["text"]
        self.parts = [p for t in texts for p in t.split("\n") if p.strip()] or ["text"]

    def some(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        at = self.rng.randrange(len(self.words))
        return escape(" ".join((self.words[at:] + self.words)[:n]))

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def maybe(self, chance: float, html: str) -> str:
        return html if self.rng.random() < chance else ""

    def box(self, label: int, names: tuple[str, ...], tokens: tuple[str, ...], inner: str) -> str:
        name = self.pick(*names)
        attribute = ""
        if name == "div" or self.rng.random() < 0.5:
            attribute = f' {self.pick("class", "id", "class")}="{self.pick(*tokens)}"'
        return f'<{name}{attribute} data-label="{label}">{inner}</{name}>'

    def links(self, low: int, high: int) -> str:
        words = [self.some(1, 4) for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.7:
            items = "".join(f'<li data-label="0"><a href="/{i}">{w}</a></li>' for i, w in enumerate(words))
            return f'<ul data-label="0">{items}</ul>'
        return self.pick(" ", " | ", "").join(f'<a href="/{w}">{w}</a>' for w in words)

    def prose(self, label: int, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            out.append(f'<p data-label="{label}">{escape(self.pick(*self.parts))}</p>' if self.rng.random() < 0.7 else f'<p data-label="{label}">{self.some(5, 40)}</p>')
        return "".join(out)

    def advert(self) -> str:
        inner = self.pick(self.some(3, 20), f'<a href="#">{self.some(2, 8)}</a>', self.prose(0, 1, 1))
        return self.box(0, ("div", "div", "aside", "section"), ("ad", "ads", "advert", "ad-box", "sponsored", "promo banner"), inner)

    def menu(self) -> str:
        return self.box(0, ("nav", "nav", "div"), ("nav", "menu", "main-menu", "navbar", "breadcrumb", "pagination"), self.links(2, 9))

    def header(self) -> str:
        inner = self.pick(self.some(1, 5), f'<h1 data-label="0">{self.some(1, 4)}</h1>', self.links(1, 5)) + self.maybe(0.4, self.menu())
        return self.box(0, ("header", "div"), ("header", "site-header", "masthead", "topbar", "banner"), inner)

    def footer(self) -> str:
        inner = "&copy; " + self.some(1, 6) + self.maybe(0.5, " &middot; " + self.some(2, 25)) + self.maybe(0.5, self.links(1, 6)) + self.maybe(0.3, self.prose(0, 1, 2))
        return self.box(0, ("footer", "footer", "div"), ("footer", "site-footer", "copyright", "legal bottom"), inner)

    def sidebar(self) -> str:
        inner = self.maybe(0.6, f'<h3 data-label="0">{self.some(1, 4)}</h3>') + self.pick(self.links(2, 8), self.prose(0, 1, 3))
        return self.box(0, ("aside", "aside", "div"), ("sidebar", "side", "related", "widget", "popular", "teaser"), inner)

    def notice(self) -> str:
        inner = self.pick(self.some(5, 30), self.prose(0, 1, 2)) + self.maybe(0.5, "<button>ok</button>")
        return self.box(0, ("div", "section", "dialog"), ("cookie-notice", "consent", "notice", "alert", "gdpr modal", "privacy-popup"), inner)

    def form(self) -> str:
        inner = self.maybe(0.6, self.some(2, 15)) + f"<label>{self.some(1, 3)}</label><input name=q>" + self.maybe(0.4, self.prose(0, 1, 1)) + "<button>go</button>"
        return f'<form data-label="0">{inner}</form>' if self.rng.random() < 0.7 else self.box(0, ("div",), ("newsletter", "login", "search-form", "subscribe"), f'<form data-label="0">{inner}</form>')

    def comments(self) -> str:
        items = ""
        for _ in range(self.rng.randint(1, 6)):
            items += self.box(0, ("div", "li", "article"), ("comment", "reply", "comment-body", "post comment"), self.maybe(0.5, self.some(1, 3)) + self.prose(0, 1, 2))
        return self.box(0, ("section", "div", "ol", "ul"), ("comments", "responses", "discussion", "replies thread"), self.maybe(0.6, f'<h2 data-label="0">{self.some(1, 3)}</h2>') + items)

    def paragraph(self) -> str:
        text = escape(self.pick(*self.parts))
        words = text.split(" ")
        if len(words) > 8 and self.rng.random() < 0.3:
            words[2] = f"<{(t := self.pick('b', 'i', 'em', 'a href=x', 'span'))}>{words[2]}</{t.split()[0]}>"
            text = " ".join(words)
        kind = self.rng.random()
        if kind < 0.6:
            return f'<p data-label="1">{text}</p>'
        if kind < 0.7:
            return f'<p data-label="1"><b>{text}<br>'
        if kind < 0.78:
            return f'<p data-label="1">{text}'
        if kind < 0.86:
            return f'<div data-label="1">{text}</div>'
        if kind < 0.9:
            return f'<blockquote data-label="1"><p data-label="1">{text}</p></blockquote>'
        if kind < 0.94:
            return f'<h2 data-label="1">{self.some(1, 8)}</h2>'
        if kind < 0.97:
            return '<ul data-label="1">' + "".join(f'<li data-label="1">{self.some(2, 20)}</li>' for _ in range(self.rng.randint(2, 5))) + "</ul>"
        return f'<table data-label="1"><tr data-label="1"><td data-label="1">{self.some(1, 5)}</td><td data-label="1">{self.some(1, 9)}</td></tr></table>'

    def article(self) -> str:
        parts = [self.paragraph() for _ in range(self.rng.choice((1, 2, 3, 5, 8, 14)))]
        for extra, chance in ((self.advert, 0.2), (self.sidebar, 0.08), (self.form, 0.05), (self.notice, 0.05)):
            if self.rng.random() < chance:
                parts.insert(self.rng.randint(0, len(parts)), extra())
        if self.rng.random() < 0.1:
            parts.append(self.box(0, ("div",), ("share", "social", "tags"), self.links(2, 5)))
        head = self.maybe(0.75, f'<h1 data-label="1">{self.some(1, 12)}</h1>')
        inner = head + "".join(parts)
        if self.rng.random() < 0.2:
            inner = f'<div data-label="1">{inner}</div>'
        return self.box(1, ("article", "article", "main", "div", "section"), ("content", "article", "post", "entry-content", "main", "story body"), inner)

    def page(self) -> str:
        middle = self.article() + self.maybe(0.35, self.comments())
        for extra, chance in ((self.sidebar, 0.35), (self.advert, 0.5), (self.menu, 0.2), (self.form, 0.15)):
            if self.rng.random() < chance:
                middle = middle + extra() if self.rng.random() < 0.5 else extra() + middle
        if self.rng.random() < 0.3:
            middle = f'<div class="{self.pick("wrapper", "container", "page", "row")}" data-label="1">{middle}</div>'
        top = self.maybe(0.4, self.header()) + self.maybe(0.7, self.menu()) + self.maybe(0.2, self.notice())
        body = top + middle + self.maybe(0.2, self.notice()) + self.maybe(0.8, self.footer()) + self.maybe(0.1, self.notice())
        return f'<!DOCTYPE html><html data-label="1"><head><title>{self.some(1, 9)}</title></head><body data-label="1">{body}</body></html>'


def _training_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Features and labels of the elements of one made page for each text."""
    x, y = [], []
    texts = [t.as_py() for t in batch.column("text")]
    for seed, text, i in zip(batch.column("seed").to_pylist(), texts, range(len(texts))):
        page = read(_Maker(seed, [text, texts[i - 1]]).page())
        labels = np.array(page.label)
        x.append(features(page)[labels >= 0])
        y.append(labels[labels >= 0])
    x, y = np.concatenate(x), np.concatenate(y)
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y.astype(np.int32))], names=["x", "y"])


def training_pages(docs: DataFrame, text_col: str = "text", texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(x, y): elements of made pages, of about ``texts`` different texts of the corpus."""
    text = F.substring(F.col(f"`{text_col}`").cast("string"), 1, SAMPLE_CHARS).alias("text")
    some = docs.select(text).where("length(text) >= 40").withColumn("seed", F.xxhash64("text"))
    chosen = some.where(hash_share(F.col("seed"), texts, docs.count())).groupBy("seed").agg(F.min("text").alias("text"))
    schema = T.StructType().add("x", T.ArrayType(T.DoubleType())).add("y", "integer")
    return arrow_pass(materialize(chosen).repartition(1).sortWithinPartitions("seed"), _training_rows, schema)


def fit(docs: DataFrame, text_col: str = "text", texts: int = SAMPLE_TEXTS) -> boosting.Trees:
    """Fit on the driver, on the elements of ``texts`` made pages (about 30 each)."""
    table = training_pages(docs, text_col, texts).toArrow()
    if not table.num_rows:
        raise ValueError("no text of 40 characters to make training pages of")
    x = table.column("x").combine_chunks()
    x = x.flatten().to_numpy().reshape(table.num_rows, -1)
    return boosting.fit(x, table.column("y").to_numpy().astype(float))


def main_text(html: str, model: boosting.Trees) -> str:
    page = read(html)
    return text_of(page, decode(page, model.logits(features(page)))) if page.runs else ""


def extract_text(pages: DataFrame, model: boosting.Trees, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """Add the main text of each page.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by one line break. A null or empty page, and one without
    text, gives an empty string. Whole pages are read, row by row, so repeated rows
    give repeated results; all other columns are kept (one named like the new one is
    replaced); an empty table gives none.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c != out_col]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{html_col}`").cast("string").alias("html"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = _texts(batch.column("html"), held.value)
        cols = [batch.column(f"c{i}") for i in range(len(kept))] + [pa.array(out, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[*(f"c{i}" for i in range(len(kept))), "out"])

    schema = T.StructType([rows.schema[f"c{i}"] for i in range(len(kept))]).add("out", "string")
    return arrow_pass(rows, step, schema).toDF(*kept, out_col)


def _texts(column: pa.Array, model: boosting.Trees) -> list[str]:
    """Texts of a batch, scored some hundred pages at a time."""
    out: list[str] = []
    for first in range(0, len(column), 200):
        read_pages = [read(v.as_py() or "") for v in column.slice(first, 200)]
        x = [features(p) for p in read_pages]
        z = model.logits(np.concatenate(x))
        ends = np.cumsum([len(rows) for rows in x])
        for page, part in zip(read_pages, np.split(z, ends[:-1])):
            out.append(text_of(page, decode(page, part)) if page.runs else "")
    return out

"""Document trees in flat form: doc, ord (preorder), level, title, start. Trees never nest in a column."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUTING = 1.0  # cost of reading a node's outline


def headings(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """key, ord, level, title, line: Markdown headings (and lines all in bold, level 1) outside code fences."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "t"))
    w = Window.partitionBy(key).orderBy("line")
    fence = F.sum(F.col("t").rlike(r"^\s*```").cast("int")).over(w)
    marked = lines.withColumn("open", fence % 2 == 1)
    rule, bold = r"^(#{1,6})\s+(.+?)\s*$", r"^\*\*([^*]+)\*\*\s*$"
    kept = marked.filter(~F.col("open") & (F.col("t").rlike(rule) | F.col("t").rlike(bold)))
    level = F.when(F.col("t").rlike(rule), F.length(F.regexp_extract("t", rule, 1))).otherwise(1)
    title = F.when(F.col("t").rlike(rule), F.regexp_extract("t", rule, 2)).otherwise(F.regexp_extract("t", bold, 1))
    return kept.select(key, (F.row_number().over(w) - 1).alias("ord"), level.alias("level"), title.alias("title"), "line")


def _levels(nodes: DataFrame) -> int:
    """The deepest level."""
    return nodes.agg(F.max("level").alias("m")).first()["m"] or 1


def with_parents(nodes: DataFrame, key: str = "doc", levels: int | None = None) -> DataFrame:
    """Adds node_id (four digits in preorder), parent (ord of the nearest earlier node of a smaller level) and is_leaf.

    The nearest smaller level is found with one running maximum for each level, without joining nodes to each other. levels is the deepest one; without it
    the nodes are asked.
    """
    levels = levels or _levels(nodes)
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    lasts = {v: F.max(F.when(F.col("level") == v, F.col("ord"))).over(w) for v in range(1, levels)}
    parent = F.greatest(F.lit(None).cast("int"), F.lit(None).cast("int"), *[F.when(F.col("level") > v, lasts[v]) for v in range(1, levels)])
    nxt = F.lead("level").over(Window.partitionBy(key).orderBy("ord"))
    return nodes.withColumn("parent", parent).withColumn("is_leaf", F.coalesce(nxt <= F.col("level"), F.lit(True))).withColumn("node_id", F.lpad(F.col("ord").cast("string"), 4, "0"))


def with_ends(nodes: DataFrame, pages: str = "pages", key: str = "doc") -> DataFrame:
    """Adds end: the page before the next node's start, or that page itself where the next heading doesn't open it (opens: false); the last page at the end. An end
    that a node has already is kept."""
    w = Window.partitionBy(key).orderBy("ord")
    nxt, opens = F.lead("start").over(w), F.lead("opens").over(w)
    found = F.greatest("start", F.coalesce(F.when(opens, nxt - 1).otherwise(nxt), F.col(pages)))
    return nodes.withColumn("end", F.coalesce("end", found) if "end" in nodes.columns else found)


def residual_pages(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, span, covered, residual: pages of a node's own range that no child has. nodes: key, ord, parent, start, end."""
    return _left(_own_and_kids(nodes, key), key).select(key, "ord", F.col("span").cast("long").alias("span"), "residual")


def _own_and_kids(nodes: DataFrame, key: str, *more: str) -> DataFrame:
    """Every node as its own range (child: false) and as one of its parent's children (child: true), as _left takes them."""
    own = F.struct("ord", F.lit(False).alias("child"), "start", "end", *more)
    kid = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("ord"), F.lit(True).alias("child"), "start", "end", *more))
    return nodes.select(key, F.explode(F.array_compact(F.array(own, kid))).alias("r")).select(key, "r.*")


def _left(ranges: DataFrame, key: str, *more: str) -> DataFrame:
    """key, ord, span, residual (pages of a node's own range that no child has), scan (the longest child's pages), children (how many), and more columns of the
    node's own row. Children are met in order of their first page and count from where those before them ended, so that no page becomes a row.

    ranges: key, ord, child, start, end, more. Pages lie between start and end, whichever is less; without both there are none.
    """
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    rows = ranges.withColumn("_a", F.when(both, F.least("start", "end"))).withColumn("_b", F.when(both, F.greatest("start", "end")))
    w = Window.partitionBy(key, "ord").orderBy("child", "_a")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.max(F.when(~F.col("child"), F.col(c)))
    first, last = own("_a").over(so_far), own("_b").over(so_far)
    done = F.coalesce(F.max(F.when(F.col("child"), F.col("_b"))).over(before), first - 1)
    new = F.least("_b", last) - F.greatest(F.col("_a") - 1, first - 1, done)
    met = rows.withColumn("_n", F.when(F.col("child") & both & first.isNotNull(), F.greatest(new, F.lit(0))))
    out = met.groupBy(key, "ord").agg(
        F.count_if(~F.col("child")).alias("_own"), own("start").alias("_s"), own("end").alias("_e"), F.coalesce(own("_b") - own("_a") + 1 - F.coalesce(F.sum("_n"), F.lit(0)), F.lit(0)).cast("long").alias("residual"),
        F.max(F.when(F.col("child"), F.col("end") - F.col("start") + 1)).alias("scan"), F.count_if("child").alias("children"), *[own(c).alias(c) for c in more],
    )
    return out.filter("_own > 0").select(key, "ord", (F.col("_e") - F.col("_s") + 1).alias("span"), "residual", "scan", "children", *more)


def offset_mode(pairs: DataFrame) -> DataFrame:
    """doc, offset, n: the commonest difference of physical and printed page, the one seen first of equals, then the least. pairs: doc, pos, printed, physical."""
    c = pairs.groupBy("doc", (F.col("physical") - F.col("printed")).alias("offset")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc").orderBy(F.col("n").desc(), "first", "offset")
    return c.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("doc", "offset", "n")


def title_pairs(contents: DataFrame, found: DataFrame, start: int = 1, key: str = "doc") -> DataFrame:
    """key, pos, printed, physical for offset_mode: entries of a printed table of contents and titles found in the text, of one document and equal to the letter, found
    on page ``start`` or later. pos follows the order of found, then of contents.

    contents: key, ord, title, page (printed, perhaps null). found: key, ord, title, physical (perhaps null). A title without a printed page gives no difference;
    a missing title equals another missing one. Titles repeated on both sides pair with each other.
    """
    there = found.filter(F.col("physical") >= start).select(key, F.col("ord").alias("_f"), F.col("title").alias("_t"), "physical")
    listed = contents.filter("page is not null").select(F.col(key).alias("_key"), F.col("ord").alias("_c"), "title", F.col("page").alias("printed"))
    both = there.join(listed, (F.col(key) == F.col("_key")) & F.col("_t").eqNullSafe(F.col("title")))
    return both.select(key, F.struct(F.col("_f").alias("found"), F.col("_c").alias("listed")).alias("pos"), "printed", "physical")


def shift_pages(contents: DataFrame, offsets: DataFrame, key: str = "doc") -> DataFrame:
    """contents with physical: the printed page moved by its document's offset (see offset_mode); null where either is missing."""
    moved = contents.join(offsets.select(F.col(key).alias("_key"), "offset"), F.col(key) == F.col("_key"), "left")
    return moved.withColumn("physical", F.col("page") + F.col("offset")).drop("_key", "offset")


def order_issues(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """Siblings that start before the one ahead of them."""
    w = Window.partitionBy(key, "parent").orderBy("ord")
    return nodes.withColumn("_b", F.lag("start").over(w)).filter("start < _b").drop("_b")


def gaps(nodes: DataFrame, pages: DataFrame, key: str = "doc") -> DataFrame:
    """key, page: pages that no node has. pages: key, pages."""
    all_pages = pages.select(key, F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    return all_pages.join(nodes.select(key, F.explode(F.sequence("start", "end")).alias("page")).distinct(), [key, "page"], "left_anti")


def by_document(rows: DataFrame, fold, schema: str, key: str = "doc") -> DataFrame:
    """A fold over the rows of whole documents (key, ord, ...) in order, a few at a time, with the place of each in its document, from 1 (_at). Documents pass through
    their task as a stream, where the last one of a batch waits for the rest of its rows; rows that are dealt by document already aren't dealt again. A document is never split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # rows of one document
        for part in batches:
            at = np.flatnonzero(part["_at"] == 1)
            if not len(at):
                held.append(part)
                continue
            if at[-1]:
                held.append(part.iloc[: at[-1]])
            if held:
                yield fold(pd.concat(held, ignore_index=True))
            held = [part.iloc[at[-1] :]]
        if held:
            yield fold(pd.concat(held, ignore_index=True))

    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).mapInPandas(run, schema)


def _documents(part: pd.DataFrame, key: str) -> Iterator[tuple]:
    """(document, from, to) of ordered rows with their places; rows without a document are left out."""
    at = np.flatnonzero(part["_at"] == 1)
    to, docs = np.append(at[1:], len(part)), part[key].iloc[at]
    known = docs.notna().to_numpy()
    return zip(docs[known].tolist(), at[known].tolist(), to[known].tolist())


def collapse_costs(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, cost, kept: bottom-up, a subtree folds into its root where reading its pages costs no more than routing into it.

    A node's pages reach to the end of its subtree. Routing costs ROUTING and then the worst of the children's costs and of the pages that no child
    has. nodes: key, ord, parent, start, end.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        docs, ords, parents, starts, ends = (rows[c].tolist() for c in (key, "ord", "parent", "start", "end"))
        cost, kept, below = [0.0] * len(docs), [False] * len(docs), {}
        for i in range(len(docs) - 1, -1, -1):  # children come before their parents
            kids = below.pop((docs[i], ords[i]), [])
            last = max([ends[i], *(e for _, e, _ in kids)])
            span = last - starts[i] + 1
            cost[i] = float(span)
            if kids:
                covered, at = 0, starts[i] - 1
                for a, e, _ in sorted(kids):
                    a = max(a, at + 1)
                    if e >= a:
                        covered, at = covered + e - a + 1, e
                deep = ROUTING + max([float(span - covered), *(c for _, _, c in kids)])
                kept[i] = span > deep
                cost[i] = min(cost[i], deep)
            if parents[i] == parents[i]:  # not NaN
                below.setdefault((docs[i], int(parents[i])), []).append((starts[i], last, cost[i]))
        return pd.DataFrame({key: docs, "ord": ords, "cost": cost, "kept": kept})

    kind = nodes.schema[key].dataType.simpleString()
    return by_document(nodes.select(key, "ord", "parent", "start", "end"), fold, f"{key} {kind}, ord int, cost double, kept boolean", key)


def intervals(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, parent, depth (1 at the top), last (ord of the last descendant), path (titles from the top), low and high (first start and last end of the subtree).

    A subtree is what lies between ord and last. One pass over a document with a stack of open nodes, and one back, however deep the tree is. nodes: key, ord, level, and
    title, start, end where there are; nodes of equal level are siblings, and levels may leave gaps.
    """
    has = [c for c in ("title", "start", "end") if c in nodes.columns]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        ords, levels = part["ord"].tolist(), part["level"].tolist()
        titles, low, high = (part[c].tolist() if c in has else [None] * len(ords) for c in ("title", "start", "end"))
        keep, parents, last, paths = [], [None] * len(ords), ords[:], [None] * len(ords)
        for _, a, b in _documents(part, key):
            keep.extend(range(a, b))
            for i, p in zip(range(a, b), _parents(levels[a:b])):
                parents[i] = None if p is None else a + p
                paths[i] = [titles[i]] if p is None else [*paths[a + p], titles[i]]
            _widen(range(a, b), parents, last, low, high)
        found = pd.DataFrame({key: part[key], "ord": ords, "parent": [None if p is None else ords[p] for p in parents], "depth": [len(p) if p else 0 for p in paths], "last": last, "path": paths, "low": low, "high": high})
        return found.iloc[keep].astype({c: "Int32" for c in ("ord", "parent", "depth", "last", "low", "high")})

    kind = nodes.schema[key].dataType.simpleString()
    return by_document(nodes.select(key, "ord", "level", *has), fold, f"{key} {kind}, ord int, parent int, depth int, last int, path array<string>, low int, high int", key)


def _parents(levels: list) -> list:
    """Of a document's levels in order the place of each node's parent, None at the top, by a stack of open nodes."""
    out, open_ = [None] * len(levels), []
    for i, level in enumerate(levels):
        while open_ and levels[open_[-1]] >= level:
            open_.pop()
        if open_:
            out[i] = open_[-1]
        open_.append(i)
    return out


def _widen(places: range, parents: list, last: list, low: list, high: list) -> None:
    """Sets last, low and high of each node to those of its subtree."""
    for i in reversed(places):  # children come before their parents
        p = parents[i]
        if p is not None:
            last[p] = max(last[p], last[i])
            low[p] = low[i] if low[p] != low[p] or low[p] is None else low[p] if low[i] != low[i] or low[i] is None else min(low[p], low[i])
            high[p] = high[i] if high[p] != high[p] or high[p] is None else high[p] if high[i] != high[i] or high[i] is None else max(high[p], high[i])


def ancestors(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, path: titles from the root to each node."""
    return intervals(nodes, key).select(key, "ord", "path")


def subtree(nodes: DataFrame, picks: DataFrame, key: str = "doc") -> DataFrame:
    """Nodes that lie in the subtree of a pick (key, top), the pick too: key, top and the columns of nodes. One join, as a subtree is a range of ord."""
    ranges = intervals(nodes, key).select(key, F.col("ord").alias("top"), F.col("last").alias("_last")).join(picks.select(key, "top").distinct(), [key, "top"], "left_semi")
    return nodes.join(ranges, key).filter(F.col("ord").between(F.col("top"), F.col("_last"))).drop("_last")


def expand_cost(nodes: DataFrame, children: DataFrame | str, key: str = "doc") -> DataFrame:
    """key, ord, cost, residual, expand: one step of lookahead, the proposed children as collapsed; expand if the node has more than LEAST_SPAN pages and that costs less than
    reading them. children: key, ord of the parent, start, end; or the name of a column of nodes, arrays of (start, end), where these are few."""
    ranges = lambda rows, child: rows.select(key, "ord", F.lit(child).alias("child"), "start", "end")
    if isinstance(children, str):
        row = lambda child, a, b: F.struct(F.lit(child).alias("child"), a.alias("start"), b.alias("end"))
        each = F.concat(F.array(row(False, F.col("start"), F.col("end"))), F.transform(children, lambda c: row(True, c["start"], c["end"])))
        every = nodes.select(key, "ord", F.explode(each).alias("r")).select(key, "ord", "r.*")
    else:
        every = ranges(nodes, False).unionByName(ranges(children, True))
    out = _left(every, key).filter("children > 0")
    cost = ROUTING + F.greatest("scan", "residual")
    return out.select(key, "ord", cost.cast("double").alias("cost"), "residual", ((F.col("span") > LEAST_SPAN) & (cost < F.col("span"))).alias("expand"))


LEAST_SPAN = 5  # fixed value: only nodes of more pages are expanded
LONGEST_TITLE = 200  # of joined titles


def merge_same_page(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """nodes with leaves of one parent that cover the same pages merged into the first: title becomes the joined titles, or the pages if that is empty or
    longer than LONGEST_TITLE; merged counts the leaves. nodes: key, ord, parent, is_leaf, title, start, end."""
    same = F.when(F.col("is_leaf"), F.concat_ws("-", F.lit("pages"), "start", "end")).otherwise(F.concat(F.lit("node"), F.col("ord").cast("string")))
    groups = nodes.withColumn("_s", same).groupBy(key, "parent", "_s")
    parts = groups.agg(F.sort_array(F.collect_list(F.struct("ord", "title", "is_leaf", "start", "end"))).alias("m"))
    first = F.element_at("m", 1)
    joined = F.array_join(F.transform(F.filter("m", lambda x: F.coalesce(x["title"], F.lit("")) != ""), lambda x: x["title"]), "; ")
    label = F.concat(F.lit("p."), first["start"].cast("string"), F.when(first["end"] != first["start"], F.concat(F.lit("-"), first["end"].cast("string"))).otherwise(""))
    title = F.when(F.size("m") == 1, first["title"]).when((joined == "") | (F.length(joined) > LONGEST_TITLE), label).otherwise(joined)
    return parts.select(key, first["ord"].alias("ord"), "parent", first["is_leaf"].alias("is_leaf"), title.alias("title"), first["start"].alias("start"), first["end"].alias("end"), F.size("m").cast("long").alias("merged"))


def thin_pages(nodes: DataFrame, key: str = "doc", most_nodes: int = 20, least_pages: int = 3) -> DataFrame:
    """key, ord, end of the nodes that stay: from the root down, a node whose pages up to its last descendant are one, or fewer than ``least_pages`` in a
    tree of over ``most_nodes`` nodes, loses its subtree and takes over its end. nodes: key, ord, parent, start, end."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        every = [rows[c].tolist() for c in ("ord", "parent", "start", "end")]
        for doc, at, to in _documents(rows, key):
            ords, parents, starts, ends = (c[at:to] for c in every)
            last_kid = {int(p): o for o, p in zip(ords, parents) if p == p}
            end, gone = dict(zip(ords, ends)), set()
            final = {}
            for o in reversed(ords):  # the end of the last descendant
                final[o] = final[last_kid[o]] if o in last_kid else end[o]
            for o, p, a in zip(ords, parents, starts):
                if p == p and int(p) in gone:
                    gone.add(o)
                    continue
                n = final[o] - a + 1
                if o in last_kid and (n == 1 or len(ords) > most_nodes and n < least_pages):
                    gone.add(o)
                    out.append((doc, o, final[o]))
                else:
                    out.append((doc, o, end[o]))
        return pd.DataFrame(out, columns=[key, "ord", "end"])

    kind = nodes.schema[key].dataType.simpleString()
    return by_document(nodes.select(key, "ord", "parent", "start", "end"), fold, f"{key} {kind}, ord int, end int", key)


def valid_pages(entries: DataFrame, pages: str = "pages", first: str = "first_page") -> DataFrame:
    """entries with physical (a number, perhaps as text in <physical_index_N>) as a number, null outside of the document's pages."""
    n = F.regexp_extract(F.col("physical").cast("string"), r"([0-9]+)", 1).try_cast("int")
    return entries.withColumn("physical", F.when((n >= F.col(first)) & (n <= F.col(first) + F.col(pages) - 1), n))


SUMMARY_CHARS = 600


def fallback_summary(nodes: DataFrame, text: str = "text", key: str = "doc") -> DataFrame:
    """key, ord, summary: a parent's child titles, a leaf's own text in one line, cut to SUMMARY_CHARS; the title if that is empty."""
    kids = nodes.filter("parent is not null").groupBy(key, F.col("parent").alias("ord")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), "title"))).alias("_k"))
    out = nodes.join(kids, [key, "ord"], "left")
    named = F.array_join(F.transform(F.filter("_k", lambda x: F.coalesce(x["title"], F.lit("")) != ""), lambda x: x["title"]), "; ")
    own = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    summary = F.substring(F.when(F.col("_k").isNotNull(), named).otherwise(own), 1, SUMMARY_CHARS)
    return out.select(key, "ord", F.when(summary != "", summary).otherwise(F.coalesce("title", F.lit(""))).alias("summary"))


def node_text(nodes: DataFrame, pages: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, text: the texts of each node's own pages (see own_pages) in order. pages: key, page, text."""
    each = own_pages(nodes, key).filter("last >= first").select(key, "ord", F.explode(F.sequence("first", "last")).alias("page"))
    found = each.join(pages.select(key, "page", "text"), [key, "page"]).groupBy(key, "ord").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return nodes.select(key, "ord").join(found, [key, "ord"], "left").select(key, "ord", F.coalesce(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit("")).alias("text"))


#: What a picked node shows of its pages, and what is shown of a document that has no pages.
SLICE_CHARS, WHOLE_CHARS = 8000, 4000


def retrieve_nodes(picks: DataFrame, nodes: DataFrame, pages: DataFrame, top: int = 5, key: str = "doc", whole: DataFrame | None = None, separator: str = "", most: int | None = None) -> DataFrame:
    """query_id, key, rank, ord, title, start, end, text of the nodes that a model picked: the first picks of each query over all parts of the outline, each
    node once, at most ``top``. picks: query_id, key, part, pos, node_id.

    The text is that of the node's pages, ``separator`` between them, cut to ``most`` characters if given; a node without an end shows its first page, one without a
    start nothing. whole (key, text) are documents without pages: their nodes show the first WHOLE_CHARS. A summary of nodes comes along.
    """
    once = picks.groupBy("query_id", key, "node_id").agg(F.min(F.struct("part", "pos")).alias("at"))
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", key, "node_id"))).filter(F.col("rank") <= top)
    also = ["summary"] if "summary" in nodes.columns else []
    found = best.join(nodes.select(key, "node_id", "ord", "title", "start", "end", *also), [key, "node_id"])
    first = F.greatest(F.col("start"), F.lit(1))
    last = F.when(F.coalesce(F.col("end"), F.lit(0)) == 0, first).otherwise(F.col("end"))
    spans = found.select("query_id", key, "rank", first.alias("a"), last.alias("b"), "start").filter("start is not null and b >= a")
    text = spans.select("query_id", key, "rank", F.explode(F.sequence("a", "b")).alias("page")).join(pages.select(key, "page", "text"), [key, "page"])
    text = text.groupBy("query_id", key, "rank").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    out = found.join(text, ["query_id", key, "rank"], "left")
    shown = F.coalesce(F.array_join(F.transform("p", lambda x: x["text"]), separator), F.lit(""))
    shown = shown if most is None else F.substring(shown, 1, most)
    if whole is not None:
        out = out.join(whole.select(key, F.substring("text", 1, WHOLE_CHARS).alias("_whole")), key, "left")
        shown = F.coalesce(F.col("_whole"), shown)
    return out.select("query_id", key, "rank", "ord", "title", "start", "end", *also, shown.alias("text"))


# ---- parts of trees that are packed in order -------------------------------------------------------------------------


def paginate(rows: DataFrame, text: str, size: int, key: str = "doc", overlap: int = 1) -> DataFrame:
    """key, page, first, last: rows (key, ord) packed in order into parts; a part begins with the last ``overlap`` rows of the one before.

    A document of at most ``size`` characters is one part. Else a part ends before the row that would take it over the mean of ``size`` and the characters
    that as many parts as are needed would hold evenly; the row starts the next part even if it is larger. The packing of one document is a fold over
    its rows; only lengths go in.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        every = [part[c].tolist() for c in ("ord", "n")]
        for doc, at, to in _documents(part, key):
            ords, lengths = (c[at:to] for c in every)
            total, parts = sum(lengths), []
            if total <= size:
                parts = [(0, len(ords) - 1)]
            else:
                budget, start, held = math.ceil((total / math.ceil(total / size) + size) / 2), 0, 0
                for i, n in enumerate(lengths):
                    if held + n > budget:
                        parts.append((start, i - 1))
                        start = max(i - overlap, 0)
                        held = sum(lengths[start:i])
                    held += n
                parts.append((start, len(ords) - 1))
            out += [(doc, p, ords[a] if b >= a else None, ords[b] if b >= a else None) for p, (a, b) in enumerate(parts)]
        return pd.DataFrame(out, columns=[key, "page", "first", "last"]).astype({"first": "Int32", "last": "Int32"})

    kind = rows.schema[key].dataType.simpleString()
    return by_document(rows.select(key, "ord", F.length(text).alias("n")), fold, f"{key} {kind}, page int, first int, last int", key)


def from_codes(rows: DataFrame, key: str = "doc") -> DataFrame:
    """Adds parent_code to rows with dotted codes ('1.2.3'): the code without its last part where that exists, else null."""
    up = F.when(F.col("code").contains("."), F.regexp_replace("code", r"\.[^.]*$", ""))
    codes = rows.select(key, F.col("code").alias("_c")).distinct()
    out = rows.withColumn("_u", up).join(codes.withColumnRenamed("_c", "_u").withColumn("_has", F.lit(True)), [key, "_u"], "left")
    return out.withColumn("parent_code", F.when(F.col("_has"), F.col("_u"))).drop("_u", "_has")


def with_preface(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """A node titled Preface (ord -1) for the pages before a document's first heading."""
    first = nodes.groupBy(key).agg(F.min("start").alias("s")).filter("s > 1")
    return nodes.select(key, "ord", "title", "start", "end").unionByName(first.select(key, F.lit(-1).alias("ord"), F.lit("Preface").alias("title"), F.lit(1).alias("start"), (F.col("s") - 1).alias("end")))


def covering_ranges(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, start, end widened to all descendants."""
    def fold(part: pd.DataFrame) -> pd.DataFrame:
        levels = part["level"].tolist()
        low, high = ((part[c].astype(float) if part[c].isna().any() else part[c]).tolist() for c in ("start", "end"))  # missing: NaN
        for _, a, b in _documents(part, key):
            open_ = []
            for i in range(a, b + 1):
                while open_ and (i == b or levels[open_[-1]] >= levels[i]):  # a node that ends widens its parent
                    done = open_.pop()
                    if open_:
                        p = open_[-1]
                        if low[done] < low[p] or low[p] != low[p]:
                            low[p] = low[done]
                        if high[done] > high[p] or high[p] != high[p]:
                            high[p] = high[done]
                open_.append(i)
        found = pd.DataFrame({key: part[key], "ord": part["ord"], "start": low, "end": high})[part[key].notna()]
        return found.astype({"ord": "Int32", "start": "Int32", "end": "Int32"})

    kind = nodes.schema[key].dataType.simpleString()
    return by_document(nodes.select(key, "ord", "level", "start", "end"), fold, f"{key} {kind}, ord int, start int, end int", key)


#: Fixed value: what the title of a node for a parent's opening pages ends in.
INTRO = " (intro)"


def intro_title(title: Column) -> Column:
    """The title of a parent's node for its opening pages; a split intro keeps its own."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when(t == "", "Intro").when(t.endswith(INTRO), t).otherwise(F.concat(t, F.lit(INTRO)))


def add_intro_nodes(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, level, title, start, end, intro: nodes with a first child for the opening pages of each parent whose first child starts on a later page, all numbered anew.

    It ends where the parent does, and no later than on the first child's page, or on the page before if that child's heading opens its page (opens). nodes: key, ord,
    level, parent, title, start, end, opens.
    """
    first = nodes.filter("parent is not null").groupBy(key, F.col("parent").alias("ord")).agg(F.min(F.struct("ord", "start", F.coalesce("opens", F.lit(False)).alias("opens"), "level")).alias("c"))
    until = F.when(F.col("c.opens"), F.col("c.start") - 1).otherwise(F.col("c.start"))
    opening = nodes.join(first, [key, "ord"]).filter(F.col("c.start") > F.col("start"))
    made = opening.select(key, F.col("ord").alias("_o"), F.lit(1).alias("_i"), F.col("c.level").alias("level"), intro_title(F.col("title")).alias("title"), "start", F.greatest("start", F.least("end", until)).alias("end"))
    every = nodes.select(key, F.col("ord").alias("_o"), F.lit(0).alias("_i"), "level", "title", "start", "end").unionByName(made)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_o", "_i")) - 1
    return every.select(key, place.alias("ord"), "level", "title", "start", "end", (F.col("_i") == 1).alias("intro"))


def complexity(nodes: DataFrame, pages: str = "pages", key: str = "doc") -> DataFrame:
    """key, frontier, worst, average, normalized, max_depth, mean_depth, mass: what finding a page of a document costs by its tree.

    The frontier are leaves, by all their pages, and parents' pages that no child has, one step deeper. The average weighs each by its share of the document's pages, and
    a page lies in the middle of what is read. mass is over 1 where ranges overlap. nodes: key, ord, level, parent, start, end, pages.
    """
    ranges = _own_and_kids(nodes.withColumn("total", F.max(pages).over(Window.partitionBy(key))), key, "level", "total")
    columns = [key, "ord", "span", "residual", "children", "level", "total"]
    rows = _left(ranges, key, "level", "total").select(*columns)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        levels, depth = part["level"].tolist(), [0] * len(part)
        for _, a, b in _documents(part, key):
            open_ = []  # levels of the node and those above it
            for i in range(a, b):
                while open_ and open_[-1] >= levels[i]:
                    open_.pop()
                open_.append(levels[i])
                depth[i] = len(open_)
        return part[columns].assign(depth=depth)[part[key].notna()]

    deep = by_document(rows, fold, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", depth int", key)
    parent = F.col("children") > 0
    entries = deep.select(key, "total", F.when(parent, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), F.when(parent, F.col("residual")).otherwise(F.col("span")).alias("n")).filter("n > 0")
    cost = entries.withColumn("p", F.col("n") / F.col("total"))
    worst = F.max(ROUTING * F.col("depth") + F.col("n"))
    return cost.groupBy(key).agg(
        F.count("*").alias("frontier"), worst.alias("worst"), F.round(F.sum(F.col("p") * (ROUTING * F.col("depth") + (F.col("n") + 1) / 2)), 3).alias("average"), F.round(worst / F.max("total"), 4).alias("normalized"),
        F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 2).alias("mean_depth"), F.round(F.sum("p"), 4).alias("mass"),
    )


def own_pages(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ord, first, last: a node's own pages, a parent's up to and with its first child's start, as that child's heading may sit mid-page; last is null
    where the first child is the parent's intro."""
    child = nodes.filter("parent is not null").groupBy(key, F.col("parent").alias("ord")).agg(F.min(F.struct("ord", "start", "title")).alias("c"))
    out = nodes.join(child, [key, "ord"], "left")
    intro = (F.col("c.start") == F.col("start")) & F.col("c.title").eqNullSafe(intro_title(F.col("title")))
    return out.select(key, "ord", F.col("start").alias("first"), F.when(F.col("c").isNull(), F.col("end")).when(~intro, F.least("end", F.col("c.start"))).alias("last"))


def frontier_cost(frontier: DataFrame, key: str = "doc") -> DataFrame:
    """key, worst, expected of frontier nodes (depth, pages): routing to the depth, then reading; weighted by pages for the mean."""
    worst = F.max(ROUTING * F.col("depth") + F.col("pages"))
    mean = F.sum(F.col("pages") * (ROUTING * F.col("depth") + (F.col("pages") + 1) / 2)) / F.sum("pages")
    return frontier.groupBy(key).agg(worst.alias("worst"), mean.alias("expected"))


def thin(nodes: DataFrame, least: int, key: str = "doc") -> DataFrame:
    """key, ord, into: from the last node to the first, a node of fewer than ``least`` words takes in all its descendants that are left, and stays. nodes: key,
    ord, level, words."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        ords, levels, words = (part[c].tolist() for c in ("ord", "level", "words"))
        into = list(range(len(ords)))
        for _, at, to in _documents(part, key):
            for i in range(to - 1, at - 1, -1):
                if words[i] < least:
                    level, j = levels[i], i + 1
                    while j < to and levels[j] > level:
                        if into[j] == j:
                            words[i] += words[j]
                        into[j] = i
                        j += 1
        return pd.DataFrame({key: part[key], "ord": part["ord"], "into": part["ord"].to_numpy()[into]})[part[key].notna()]

    kind = nodes.schema[key].dataType.simpleString()
    return by_document(nodes.select(key, "ord", "level", "words"), fold, f"{key} {kind}, ord int, into int", key)

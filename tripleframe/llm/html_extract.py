"""Main text of web pages by template deduction from equivalence classes.

A page is read as tokens: tags with their path, class and id, and the texts that stand between them. Per host, tokens
with the same vector of occurrences over the host's pages form a class; vectors are compared by an order-free
fingerprint (the sum of a hash of page and count), so they are summed up before any shuffle and never gathered.
Classes that occur in most of a host's pages and have several tokens are candidates. A second reading checks them by
positions: in a class of k tokens the i-th occurrence in a page is always that of the same token, modulo k, and
of two classes one lies in a single slot of the other, wherever both occur; of two that interleave, the one in fewer
pages goes. Nested in one another's slots, the classes that stay are the host's template.

What is left between the template's tokens are its slots. The main text is that of the slots in the article (or main)
element; a host's pages without one are read from the *container*: the innermost element of the template that holds
most of the text of all slots, over all pages. Texts of the template are no content, in an article neither. Elements
that mark menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments label slots as such.

Defined results: null or empty html has an empty text; a null url or one without a host belongs to the host ''; pages
of hosts with fewer than `PAGES` different pages have no template and keep to the elements; an article of nothing but
template texts (most of its host's pages are copies of it) keeps to the elements too; equal pages count once, whatever
their ids, and get equal texts; pages of any length are read whole, in time and memory that grow with their length
alone, however deep elements nest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import blocks
from .common import dropped, only, written

#: Pages of a host from which a template is deduced, and the share of them that a class must occur in.
PAGES, SHARE = 5, 0.5
#: Tokens of a class, and the share of a host's text that its container holds.
TOKENS, MOST = 3, 0.6
#: Template tokens of all hosts that may be broadcast; more are joined by a shuffle.
FEW = 500_000
#: Tokens that a task sums up before it hands them on.
HELD = 200_000
MASK = (1 << 40) - 1

# Elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html li option tbody td tfoot th thead tr".split())
APART = frozenset("nav header footer aside form script style noscript template iframe button select textarea option svg math canvas object audio video head title dialog menu".split())
MAIN = frozenset("article main".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol table article main section div body html nav aside header footer form dl blockquote".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|comments?|comment-?list|disqus|replies|respond|share|sharing|social|related|login|signup|search)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
NAMED = re.compile("class|id|role|hidden", re.I).search
DIGITS = re.compile(r"\d+").sub
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$|["'])""", re.I)


def hints(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Class and id without their numbers, and whether an element holds no main text. An article's own header does."""
    off = tag in APART and not (tag == "header" and inside)
    sign = ""
    if not attributes or not NAMED(attributes):
        return sign, off
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id"):
            sign += f" {name}={DIGITS('#', value)}"
        if tag in MAIN or tag in ("html", "body"):
            continue
        off |= name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name in ("class", "id") and bool(MARKED.search(value))
    return sign, off


def parse(page: str) -> Iterator[tuple[int, str | None, int, bool, bool, bool, bool]]:
    """(a tag's token or a text's path, text or None for a tag, depth, opens an element, in the article, apart, a block
    begins here) in page order. A path is the hash of its parent's and its own tag, so that depth costs nothing."""
    stack: list[tuple[str, bool, bool, int]] = []  # tag, inside the article, apart, path
    opened: dict[str, list[int]] = {}  # places of each tag in the stack

    def pop(n: int) -> None:
        for tag, *_ in reversed(stack[n:]):
            opened[tag].pop()
        del stack[n:]

    def last(tags: frozenset[str] | set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    at, size, fresh = 0, len(page), True
    while at < size:
        found = TOKEN.search(page, at)
        end = found.start() if found else size
        inside, off, path = stack[-1][1:] if stack else (False, False, 0)
        if end > at:
            text = page[at:end]
            yield path, text, len(stack), False, inside, off, fresh
            fresh = False
        if not found:
            return
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            n = last({tag})
            if n >= 0 and (tag in BLOCK or last(SCOPE) < n):
                pop(n)
            fresh |= tag in BLOCK
            yield token_hash(stack[-1][3] if stack else 0, "/" + tag), None, len(stack), False, inside, off, fresh
            continue
        if tag in CLOSES_P and (n := last({"p"})) > last(SCOPE):
            pop(n)
        if tag in SAME and (n := last(SAME[tag])) > last(SCOPE):
            pop(n)
        inside, off, path = stack[-1][1:] if stack else (False, False, 0)
        fresh |= tag in BLOCK
        sign, apart = hints(tag, found[3], inside)
        token = token_hash(path, f"<{tag}{sign}")
        opens = tag not in RAW and tag not in VOID and not found[3].rstrip().endswith("/")
        yield token, None, len(stack), opens, inside or tag in MAIN, off or apart, fresh
        if tag in RAW:
            close = closing(tag)(page, at)
            at = close.end() if close else size
            fresh |= tag in ("title", "textarea")
        elif tag == "br":
            yield path, " ", len(stack), False, inside, off, fresh
        elif opens:
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, inside or tag in MAIN, off or apart, token))


@lru_cache(maxsize=64)
def closing(tag: str):
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I).search


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", 1)), F.lit(""))


def squeezed(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def token_hash(path: int, what: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}{what}") & 0x7FFFFFFFFFFFFFFF


def text_token(path: int, text: str) -> int:
    return token_hash(path, "#" + squeezed(text))


def different(pages: DataFrame) -> DataFrame:
    """host and html of each different page of a host. Only pages that occur twice are shuffled."""
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumns({"h1": F.xxhash64("html"), "h2": F.xxhash64(F.lit(3), "html")})
    key = ["host", "h1", "h2"]
    again, _ = written(rows.groupBy(*key).count().where("count > 1").select(*key), "repeated-pages")
    n = again.count()
    if not n:
        return rows.select("host", "html")
    again = F.broadcast(again) if n <= FEW else again
    return rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(key)).select("host", "html")


class Sums:
    """Rows of counts by key, handed on when there are HELD of them."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.held = names, kinds, {}

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.held) >= least:
            keys = list(self.held)
            width, more = len(keys[0]), len(self.held[keys[0]])
            columns = [[k[i] for k in keys] for i in range(width)] + [[self.held[k][i] for k in keys] for i in range(more)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.kinds, strict=True)], self.names)
            self.held.clear()


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, token, is_text, pages, total (occurrences) and vector, over the rows of different()."""
    names = ["host", "token", "is_text", "pages", "total", "vector"]

    def run(batches):
        sums = Sums(names, [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()])
        for batch in batches:
            for lo, hi in blocks(batch.column(1)):
                for of, page in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns), strict=True):
                    key = xxhash.xxh64_intdigest(page)
                    seen = Counter((token, False) if text is None else (text_token(token, text), True) for token, text, *_ in parse(page) if text is None or not text.isspace())
                    for (token, is_text), n in seen.items():
                        held = sums.held.setdefault((of, token, is_text), [0, 0, 0])
                        held[0] += 1
                        held[1] += n
                        held[2] = (held[2] + (xxhash.xxh64_intdigest(f"{key} {n}") >> 24)) & MASK  # sums of 40 bits, modulo 2**40
                    yield from sums.out(HELD)
        yield from sums.out()

    kind = "host string, token long, is_text boolean, pages long, total long, vector long"
    return pages.mapInArrow(run, kind).groupBy("host", "token", "is_text").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("vector").bitwiseAND(MASK).alias("vector"))


def candidates(vectors: DataFrame) -> DataFrame:
    """host, and the classes (class, pages, tokens) that may belong to its template. A class is told by its vector, and
    by pages and total, which the vector's hash need not tell apart."""
    sizes = vectors.groupBy("host").agg(F.max("pages").alias("host_pages"))  # every page has its first tag or text
    often = vectors.where(F.col("pages") >= PAGES * SHARE)  # what a page alone has never meets the other tokens of its host
    kept = often.join(sizes, "host").where((F.col("host_pages") >= PAGES) & (F.col("pages") >= F.col("host_pages") * SHARE))
    of = F.xxhash64("pages", "total", "vector").alias("class")
    classes = kept.groupBy("host", of).agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= TOKENS)
    return classes.groupBy("host").agg(F.collect_list(F.struct("class", "pages", "tokens")).alias("classes"))


def with_hosts(rows: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """rows (with a host) and the other column of found."""
    return rows.join(F.broadcast(found) if size <= FEW else found, "host", "left")


def placed(joined: DataFrame) -> DataFrame:
    """host, kind, a, b, is_text, least, largest, total. Kind 0: class a, token b, its least and largest place in the class. Kind 1:
    classes a and b, the least and largest slot of b that a's tokens stand in. Kind 2: element a of class b, the text of slots within."""
    names = ["host", "kind", "a", "b", "is_text", "least", "largest", "total"]

    def run(batches):
        sums = Sums(names, [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()])

        def note(key, place, n=0):
            held = sums.held.setdefault(key, [place, place, 0])
            held[0], held[1], held[2] = min(held[0], place), max(held[1], place), held[2] + n

        for batch in batches:
            for lo, hi in blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                for of, page, classes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not classes:
                        continue
                    home = {t: c["class"] for c in classes for t in c["tokens"]}
                    k = {c["class"]: len(c["tokens"]) for c in classes}
                    at = dict.fromkeys(k, 0)
                    above: list[int] = []  # open elements that are candidates, and the text within each so far
                    text_in: list[int] = []

                    def leave(depth, above=above, text_in=text_in, home=home, of=of):
                        while len(above) > depth:
                            token, n = above.pop(), text_in.pop()
                            if text_in:
                                text_in[-1] += n
                            if token in home:
                                note((of, 2, token, home[token], False), 0, n)

                    for token, text, depth, opens, _, off, _ in parse(page):
                        leave(depth)
                        if text is not None:
                            if text.isspace():
                                continue
                            token = text_token(token, text)
                        if (c := home.get(token)) is not None:
                            note((of, 0, c, token, text is not None), at[c] % k[c])
                            for other in k:
                                if other != c:
                                    note((of, 1, c, other, False), at[other] % k[other])
                            at[c] += 1
                        elif text is not None and not off and text_in:
                            text_in[-1] += len(text)
                        if opens:
                            above.append(token)
                            text_in.append(0)
                    leave(0)
                    yield from sums.out(HELD)
        yield from sums.out()

    kind = "host string, kind int, a long, b long, is_text boolean, least long, largest long, total long"
    return joined.mapInArrow(run, kind).groupBy("host", "kind", "a", "b", "is_text").agg(F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("total").alias("total"))


def nested(found: DataFrame, classes: DataFrame) -> DataFrame:
    """host, class, and the tokens (token, place, is_text) of the classes of templates, with the class and slot that each is nested in."""
    one = classes.select("host", F.explode("classes").alias("c")).select("host", F.col("c.class").alias("a"), F.col("c.pages").alias("pages"))
    tokens = found.where("kind = 0").groupBy("host", "a").agg(F.count("*").alias("n"), F.count_if(F.col("least") == F.col("largest")).alias("fixed"), F.countDistinct("least").alias("places"), F.collect_list(F.struct(F.col("least").alias("place"), F.col("b").alias("token"), "is_text", (F.col("least") == F.col("largest")).alias("stays"))).alias("tokens"))
    ordered = tokens.withColumn("tokens", F.sort_array(F.filter("tokens", lambda t: t["stays"]))).where(F.size("tokens") >= TOKENS).join(one, ["host", "a"])
    sides = found.where("kind = 1").select("host", "a", "b", (F.col("least") == F.col("largest")).alias("within"), F.col("least").alias("slot"))
    sides = sides.join(ordered.select("host", "a", "pages"), ["host", "a"]).join(ordered.select("host", F.col("a").alias("b"), F.col("pages").alias("pages_b")), ["host", "b"])
    both = sides.join(sides.select("host", F.col("a").alias("b"), F.col("b").alias("a"), F.col("within").alias("around")), ["host", "a", "b"])
    loses = both.where(~F.col("within") & ~F.col("around") & (F.struct("pages", "a") < F.struct(F.col("pages_b"), F.col("b")))).select("host", "a").distinct()
    valid = ordered.join(loses, ["host", "a"], "left_anti")
    parents = both.where(F.col("within") & (F.col("slot") > 0) & (F.col("pages_b") >= F.col("pages"))).join(valid.select("host", F.col("a").alias("b")), ["host", "b"], "left_semi")
    parents = parents.groupBy("host", "a").agg(F.min_by(F.struct(F.col("b").alias("parent"), "slot"), F.struct("pages_b", "b")).alias("up"))
    return valid.join(parents, ["host", "a"], "left").select("host", F.col("a").alias("class"), "pages", "tokens", "up.parent", "up.slot")


def templates(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """host, the texts (as token hashes) of its template and its container; and the tables that led to it."""
    rows = different(pages)
    vectors, a = written(token_vectors(rows), "token-vectors")
    classes, b = written(candidates(vectors), "token-classes")
    size = classes.agg(F.coalesce(F.sum(F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["tokens"]))), F.lit(0))).first()[0]
    found, c = written(placed(with_hosts(rows, classes, size).select("host", "html", "classes")), "token-places")
    kept, d = written(nested(found, classes), "template-classes")
    texts = kept.select("host", F.explode("tokens").alias("t")).where("t.is_text").groupBy("host").agg(F.collect_list("t.token").alias("texts"))
    elements = found.where("kind = 2").join(kept.select("host", F.col("class").alias("b"), F.explode("tokens").alias("t")).select("host", "b", F.col("t.token").alias("a")), ["host", "a", "b"], "left_semi")
    most = elements.groupBy("host").agg(F.max("total").alias("most"))
    inner = elements.join(most, "host").where(F.col("total") >= F.col("most") * MOST).groupBy("host").agg(F.min_by("a", F.struct("total", "a")).alias("container"))
    return texts.join(inner, "host", "full").select("host", F.struct(F.coalesce("texts", F.array().cast("array<long>")).alias("texts"), "container").alias("template")), [a, b, c, d]


def main_text(page: str | None, template: frozenset[int] = frozenset(), container: int | None = None) -> str:
    """The slots that hold the article, a block each."""
    parts: list[tuple[bool, bool, list[str], list[str]]] = []  # in the article, in the container, texts, those that are no template's
    open_block: tuple[list[str], list[str]] | None = None
    where, holds = None, -1  # holds: depth of the open container
    for token, text, depth, opens, inside, off, fresh in parse(page or ""):
        if depth <= holds:
            holds = -1
        if text is None:
            if fresh:
                open_block = None
            if opens and holds < 0 and token == container:
                holds = depth
            continue
        if off:
            continue
        fixed = bool(template) and text_token(token, text) in template
        if fixed and not inside:
            continue
        if open_block is None or fresh or where != (inside, holds >= 0):
            open_block, where = ([], []), (inside, holds >= 0)
            parts.append((*where, *open_block))
        open_block[0].append(text)
        if not fixed:
            open_block[1].append(text)
    chosen = next((x for x in ([p for p in parts if p[0]], [p for p in parts if p[1]]) if x), parts)
    blocks_ = [(squeezed("".join(x)), squeezed("".join(own))) for *_, x, own in chosen]
    some = any(own for _, own in blocks_)
    return "\n\n".join(text for every, own in blocks_ if (text := own if some else every))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = only(pages, page_id="long", url="string", html="string")
    made, paths = templates(pages)
    found, _ = written(made, "templates")
    dropped(pages.sparkSession, *paths)
    size = found.agg(F.coalesce(F.sum(F.size("template.texts") + 1), F.lit(0))).first()[0]
    joined = with_hosts(pages.withColumn("host", host(F.col("url"))), found, size).select("page_id", "url", "html", "template.texts", "template.container")

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                texts = [main_text(page, frozenset(t or ()), c) for page, t, c in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")

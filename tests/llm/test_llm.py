"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties and repeated rows."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleframe.llm import bpe, chat, common, embed_dedup, html_extract, langid, minhash, packing, queries, suffix, topk, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"
WORDS = "the of and to in ing er thand that with ountion edble shion wher onti ansh reth erou".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS)]) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en", "src", None if t is None else len(t), "extra") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (300, 200, 120, 900)]
    passage = prose(rng, 160)
    near = base[0].split()
    near[50] = near[200] = "changed"
    return [*base, base[0], base[0], base[1] + " end", " ".join(near), "x " + passage + " y", passage + " z é", "", None, "a b", "A  B!", "!!!", "12 34", "é" * 900, prose(rng, 30000), "ab" * 700, None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*rows_of(texts), rows_of(texts)[2]], DOCS)  # one row twice


def encode(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


# BPE ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="aeinorst'lvmdE \n0!<|>", max_size=80))
def test_bpe_equals_the_library(text):
    c = bpe.codec(PATH)
    ids = encode(text)
    assert c.encode(text) == ids
    assert c.decode(ids) == TOKENIZER.decode(ids, skip_special_tokens=False)


def test_bpe_special_tokens_and_long_words(codec):
    rng = random.Random(1)
    for text in ("a<|endoftext|>B<|startoftext|><|ENDOFTEXT|>", "x" * 30000, "".join(rng.choice("aeinorstlh") for _ in range(9000)), "!?" * 4000, "don't we'LL ΑΣ İx ǅ Ⱥ"):
        assert codec.encode(text) == encode(text)


def test_transducer_is_independent_of_its_block(codec):
    rng = random.Random(2)
    symbols = [codec.inner[ord(rng.choice("aeinorstlh"))] for _ in range(3000)]
    wanted = codec.merges.merge(symbols)
    for block in (1, 7, 500):
        machine = bpe.Transducer(codec.merges, codec.lengths, block)
        out = machine.push(symbols[:1111])
        out += machine.push(symbols[1111:])
        assert len(machine.buffer) < codec.merges.lookahead + codec.merges.longest + block
        assert out + machine.finish() == wanted


def test_slices_do_not_change_tokens(codec, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 40)
    rng = random.Random(4)
    hard = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 600))) for alphabet in ("abcst'é²!?-٣中日ア< ", "abcdest", "!?-'s", "é", "ab1 ", "中文ㄱ가ᄀ") for _ in range(25)]
    hard += ["a" * 900 + "<|endoftext|>" + "B" * 900, "the end'll " * 40, "x'" * 200]
    assert [[int(i) for part in parts for i in part] for parts in codec.streams(hard)] == [encode(x) for x in hard]
    assert all(max((len(x) for x, _ in bpe.slices(text)), default=0) <= 41 for text in ("ab" * 500, "!?" * 500, "中文" * 500, "a1" * 500))


def test_long_texts_take_bounded_memory(codec):
    import tracemalloc

    text = "".join(random.Random(6).choice("aeinorst") for _ in range(1 << 19))
    peaks = []
    for n in (1 << 17, 1 << 19):
        tracemalloc.start()
        held = sum(len(part) for part in codec.stream(text[:n]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert held
    assert peaks[1] < 1.2 * peaks[0] + (1 << 20)


def test_word_table_starts_anew_when_full(codec):
    rng = random.Random(8)
    text = prose(rng, 3000)
    table = bpe.WordTable(codec.grid, 300)
    data, starts, ends = codec.split(text)
    ids, n = table.ids(data, starts, ends)
    for a in range(0, len(starts), 50):
        got, _ = table.ids(data, starts[a : a + 50], ends[a : a + 50])
        assert got.tolist() == ids[n[:a].sum() : n[: a + 50].sum()].tolist()
    assert ids.tolist() == encode(text) and table.n <= 400


def test_byte_level_decoding_is_incremental():
    path = public_tokenizers.path("byte_bpe_50k.json")
    import json

    spec = json.load(open(path, encoding="utf-8"))
    c = bpe.Codec.__new__(bpe.Codec)
    c.texts = [""] * (max(spec["model"]["vocab"].values()) + 1)
    for t, i in spec["model"]["vocab"].items():
        c.texts[i] = t
    c.byte_level, c.back = True, {ch: b for b, ch in enumerate(bpe.byte_alphabet())}
    t = Tokenizer.from_file(path)
    ids = t.encode("naïve 中文 😀 text").ids
    machine = bpe.Decoder(c)
    assert "".join(machine.push([i]) for i in ids) + machine.finish() == t.decode(ids)
    machine = bpe.Decoder(c)
    assert machine.push(ids[:3]) + machine.push(ids[3:-1]) + machine.finish() == t.decode(ids[:-1])


def test_bpe_query_columns(docs, texts):
    for r in bpe.digests(docs, PATH, step=64).collect():
        ids = encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.where("false"), PATH).count() == 0
    assert bpe.encode_decode(docs, PATH).count() == docs.count()


# Chat ---------------------------------------------------------------------------------------------------------


def test_chat_reads_back_what_it_formats(spark):
    rng = random.Random(5)
    hard = ["", None, "\\", "<", "\\l", "\\\\l<", "<|end|>", "<|next|>\\", "a\nb", "\\### Assistant: </turn> ok", "é😀", chat.ROLE + chat.TEXT]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "<|x"]), rng.choice(hard), "x") for c in range(30) for t in range(rng.randint(1, 8))]
    rows += [(None, None, "user", "a", "x"), (None, None, "assistant", "b", "x"), (3, 0, "user", "tie", "x"), (3, 0, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    wanted = defaultdict(list)
    for c, t, r, x, _ in rows:
        wanted[c].append((t is not None, t or 0, r or "", x or ""))
    read = chat.read_back(chat.format_conversations(df))
    for r, d in zip(sorted(read.collect(), key=lambda r: str(r.conv_id)), sorted(chat.digests(read).collect(), key=lambda r: str(r.conv_id)), strict=True):
        turns = [(x[2], x[3]) for x in sorted(wanted[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d.formatted_chars == len(r.formatted)
    assert chat.digests(chat.read_back(chat.format_conversations(df.where("false")))).count() == 0


def test_chat_merges_neighbours(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "<|role|>user<|text|>a<|next|>b<|end|><|role|>assistant<|text|>c<|end|>"


# Packing ------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40), st.integers(1, 12))
def test_plans_are_whole_and_tight(histogram, groups):
    table, n = packing.plan(histogram, 64, groups)
    assert table.groupby("length").n.sum().to_dict() == histogram
    fill = [[] for _ in range(n)]
    for length, rank, count, sequence, each, offset in table.itertuples(index=False):
        for i in range(count):
            fill[sequence + i // each].append((offset + i % each * length, length))
    for parts in fill:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 64
    # so many sequences any packing needs: by volume, and as a sequence holds at most k pieces longer than 64 / (k + 1)
    least = max(-(-sum(k * v for k, v in histogram.items()) // 64), *(-(-sum(v for size, v in histogram.items() if size * (k + 1) > 64) // k) for k in (1, 2, 3)))
    assert n <= least * 1.7 + 1


def fewest(sizes, capacity):
    """Fewest sequences, by trying all."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({*rooms, capacity}):
            if room >= sizes[i]:
                left = list(rooms)
                if room in left:
                    left.remove(room)
                place(i + 1, [*left, room - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=9))
def test_plans_of_few_pieces_are_the_fewest_or_one_more(sizes):
    sizes.sort(reverse=True)
    assert packing.plan(dict(Counter(sizes)), 64)[1] <= fewest(sizes, 64) + 1


def test_plans_of_real_lengths_waste_next_to_nothing():
    """Lengths as documents have them: most short, some cut at the capacity."""
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5.8, 1.1, 60_000).astype(int) + 1, 2048)
    _, n = packing.plan(dict(Counter(lengths.tolist())))
    assert n <= -(-int(lengths.sum()) // 2048) * 1.001 + 1


def test_packing_keeps_every_token(docs, texts):
    rows = packing.pack_documents(docs, PATH, capacity=256).toPandas()
    for r in rows.itertuples():
        ids = (encode(texts[r.doc_id]) + [0])[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.start == 256 * r.piece
    assert rows.groupby("doc_id").length.sum().to_dict() == {i: (len(encode(t)) + 1) * (1 + (i == 2)) for i, t in enumerate(texts)}
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 256
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 256) + 1
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0


# HTML ---------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use</div><!-- <p>no</p> -->{body}<aside>side</aside><form><input name="q">go</form><section id="comments"><p>first!</p></section><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize(("body", "text"), [
    ("<article><h1>A &amp; B</h1><p>one<br>two &lt;x&gt; &#233;<p><b>three\n four</b></p></article>", "A & B\n\none two <x> é\n\nthree four"),
    ("<article><header><h1>H</h1></header><p>x</p><div class='share'>tweet</div><ul><li>i<li>j</ul></article>", "H\n\nx\n\ni\n\nj"),
    ("<div id=content><h2>H</h2>loose <i>text</i><p>p</div>", "H\n\nloose text\n\np"),
    ("<main><p>a</p></main><p>outside</p>", "a"),
    ("<article></article>", ""),
    ("<article><p>unclosed <b>bold<p>next &am", "unclosed bold\n\nnext &am"),
])
def test_main_text(body, text):
    page = PAGE.format(body=body)
    assert html_extract.main_text(page if "unclosed" not in body else page[: page.index("&am") + 3]) == text


def test_extraction_learns_a_hosts_template(spark):
    rng = random.Random(7)
    texts = {i: prose(rng, 20) for i in range(12)}
    rows = [(i, f"http://h.example/{i}", f"<html><body><div>Same top line</div><div><p>{t}</p></div><div>Same end line</div></body></html>", "x") for i, t in texts.items()]
    rows += [(90, "http://other.example/1", "<p>Same top line</p>", "x"), (91, None, None, "x"), (92, "http://[broken", "", "x"), (0, "http://h.example/0", rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert {i: out[i].text for i in texts} == texts
    assert out[90].text == "Same top line" and out[91].text == out[92].text == "" and out[91].url is None
    assert all(r.n_chars == len(r.text) for r in out.values()) and html_extract.extract(df).count() == len(rows)
    assert html_extract.extract(df.where("false")).count() == 0


def test_templates_reach_into_articles(spark):
    rng = random.Random(8)
    texts = [prose(rng, 20) for _ in range(12)]
    fixed = "<div><p>Read our terms before you go on</p></div>"
    moving = ["<h2>About</h2><i>Now here</i>", "<i>Now here</i><h2>About</h2>"]
    rows = [(i, f"http://h.example/{i}", f"<html><body><p>Top</p><article><h1>T{i}</h1>{fixed}<p>{t}</p></article><p>End</p></body></html>") for i, t in enumerate(texts)]
    rows += [(100 + i, f"http://m.example/{i}", f"<html><body><article>{moving[i % 2]}{fixed}<p>{t}</p></article></body></html>") for i, t in enumerate(texts)]
    rows += [(200 + i, "http://copies.example/", f"<html><body><nav>{i}</nav><article><h1>One</h1><p>{texts[0]}</p></article></body></html>") for i in range(6)]
    rows += [(300 + i, "http://few.example/", rows[i][2]) for i in range(html_extract.PAGES - 1)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(12)] == [f"T{i}\n\n{t}" for i, t in enumerate(texts)]
    # what stands in another order from page to page is no template's, what stands at one place is
    assert all("Now here" in out[100 + i] and texts[i] in out[100 + i] and "our terms" not in out[100 + i] for i in range(12))
    assert all(out[200 + i] == f"One\n\n{texts[0]}" for i in range(6))
    assert all("our terms" in out[300 + i] and texts[i] in out[300 + i] for i in range(html_extract.PAGES - 1))


def test_classes_equal_brute_force(spark):
    """Classes, their order and nesting, of pages with optional, repeated and interleaving parts, by plain loops."""
    rng = random.Random(41)
    rows = []
    for i in range(14):
        items = "".join(f"<li><i>item</i><b>{prose(rng, 2)}</b></li>" for _ in range(rng.randint(1, 4)))
        extra = "<div class=box><u>More</u><s>about</s></div>" if i % 3 else ""
        swap = ["<em>one</em>", "<code>two</code>"]
        rng.shuffle(swap)
        rows.append((i, f"http://u@H.example:80/{i}", f"<html><body><div class='top{i}'><p>Top</p></div><ul>{items}</ul>{extra}{''.join(swap)}<div class=text><h2>{prose(rng, 3)}</h2><p>{prose(rng, 30)}</p></div></body></html>"))
    seen = {i: [(t if x is None else html_extract.text_token(t, x), x is not None) for t, x, *_ in html_extract.parse(h) if x is None or x.strip()] for i, _, h in rows}
    vectors = {t: tuple(Counter(seen[i])[t] for i in seen) for i in seen for t in seen[i]}
    by_vector = defaultdict(set)
    for (t, _), v in vectors.items():
        if sum(map(bool, v)) >= 7:
            by_vector[v].add(t)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    copies = df.unionByName(df).unionByName(df.where("page_id = 3").withColumn("page_id", F.lit(None).cast("long")))
    for pages in (df, copies):
        different = html_extract.different(pages)
        assert different.count() == 14 and {r.host for r in different.collect()} == {"h.example"}
        classes = html_extract.candidates(html_extract.token_vectors(different))
        found = {frozenset(c.tokens) for c in classes.first().classes}
        assert found == {frozenset(x) for x in by_vector.values() if len(x) >= html_extract.TOKENS}
    rank = {}
    for c in found:
        v = next(v for v, x in by_vector.items() if x == c)
        order = [[t for t, _ in seen[i] if t in c] for i in seen]
        rank[c] = (sum(map(bool, v)), [t for t in c if len({place % len(c) for o in order for place, x in enumerate(o) if x == t}) == 1], order)
    classes, _ = common.written(classes, "classes-test")
    placed = html_extract.placed(html_extract.with_hosts(different, classes, 1).select("host", "html", "classes"))
    kept = html_extract.nested(placed, classes).collect()
    assert {frozenset(t.token for t in r.tokens) for r in kept} == {frozenset(stays) for _, stays, _ in rank.values() if len(stays) >= html_extract.TOKENS}
    root = next(r for r in kept if r.parent is None)
    assert root.pages == 14 and all(r.parent is not None and r.slot > 0 for r in kept if r["class"] != root["class"])


def test_containers_without_an_article(spark):
    """Neither article nor class words: the element of the template that holds most of the text."""
    rng = random.Random(43)
    texts = [(prose(rng, 4), prose(rng, 40), prose(rng, 30)) for _ in range(12)]
    page = "<html><body><div class='x'><a>{n}</a><a>Home of {n}</a></div><div class='y'><h1>{a}</h1><p>{b}</p><p>{c}</p><p>Fixed line of all</p></div><div class='z'>{n} visitors today</div></body></html>"
    rows = [(i, "http://h.example/", page.format(n=i, a=a, b=b, c=c)) for i, (a, b, c) in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for pages in (df, df.unionByName(df), df.withColumn("page_id", F.when(F.col("page_id") % 2 == 0, F.col("page_id")))):
        out = {r.text for r in html_extract.extract(pages).collect()}
        assert out == {f"{a}\n\n{b}\n\n{c}" for a, b, c in texts}


def test_depth_costs_nothing():
    import time

    took = []
    for n in (2000, 16000):
        began = time.process_time()
        assert html_extract.main_text("<div>x" * n).count("x") == n
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


# WARC ---------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    pages = [(5, "http://www.B.example/x?q=1#f", "same", "x"), (3, "https://b.example/x?q=1", "same", "x"), (9, None, None, "x"), (8, "bad url \r\n y", "", "x"), (1, "http://a.example/", "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\nx", "x"), (2, "http://a.example", "one", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, archive string")
    rows = warc.archive_and_index(df).collect()
    first = {}
    for i, _, h, _ in sorted(pages):
        first.setdefault(h or "", i)
    assert len(rows) == len(pages)
    for r in rows:
        html = next(h for i, _, h, _ in pages if i == r.page_id) or ""
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))
    keys = [(r.url_key, r.ts, r.record_id) for r in rows]
    assert keys == sorted(keys)
    assert warc.url_key("http://www.B.example/x?q=1#f") == "example,b)/x?q=1"
    assert warc.archive_and_index(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree(lists):
    made = [sorted(part) for part in lists]
    assert [made[i][j] for i, j in warc.LoserTree(made)] == sorted(x for part in lists for x in part)


def test_external_merge_of_many_runs(spark):
    """Many small runs and ranges, one URL of a third of all pages, null ids, and an archive of few long payloads."""
    rng = random.Random(31)
    pages = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{rng.randint(0, 9)}.example/{rng.randint(0, 40)}", rng.choice(["same", "é" * rng.randint(0, 50), f"own {i}"])) for i in range(400)]
    pages += [(None, None, "same"), (None, "http://x.example/", "alone"), (None, "http://x.example/", "alone"), (7, pages[7][1], pages[7][2]), (900, "http://z.example/", "z" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = f"{common.scratch(spark, 'warc-test')}"
    warc.write(df, path, per_archive=30)
    index, _ = common.written(warc.runs(spark, path, 17), "captures-test")
    assert index.groupBy("run").count().agg(F.max("count")).first()[0] <= 17
    rows = warc.merged_index(index, 25).collect()
    keys = [(r.url_key, r.ts, r.record_id) for r in rows]
    assert keys == sorted(keys) and Counter(r.page_id for r in rows) == Counter(p[0] for p in pages)
    first = {}
    for i, _, h in pages:
        first[h] = min(first.get(h, 1 << 60), 1 << 60 if i is None else i)
    for r in rows:
        if r.page_id is not None:
            html = next(h for i, _, h in pages if i == r.page_id)
            assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))
    nulls = sorted((r.url_key, r.record_type, r.refers_to) for r in rows if r.page_id is None)
    assert nulls == [("", "revisit", first["same"]), ("example,x)/", "response", None), ("example,x)/", "response", None)]


def test_a_reader_holds_one_record(spark):
    import gzip
    import io

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1000000\r\n\r\n" + b"a\r\n\r\n" * 200_000 + b"\r\n\r\n"
    stream = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(record * 20)))
    import tracemalloc

    tracemalloc.start()
    assert [at for at, _, body in warc.parse(stream) if len(body) == 1_000_000] == [i * len(record) for i in range(20)]
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


# Language -----------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(9)
    speech = {"en": "the and thing with ation ould".split(), "de": "der und schön über keit ung".split(), "fr": "le été que eaux ment ité".split()}
    rows = [(i, " ".join(rng.choice(speech[lang]) + rng.choice(["", rng.choice(speech[lang])]) for _ in range(40)), lang, "x") for i in range(300) for lang in [rng.choice(list(speech))]]
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "12 !?", "de", "x"), (None, "the thing with", None, "x"), (1003, "日本語", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for i, text, lang, _ in rows:
        r = by_id[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        if i is not None and i < 1000:
            assert r.lang_pred == lang
    assert all(by_id[i].lang_pred == "und" for i in (1000, 1001, 1002)) and by_id[1003].lang_pred in speech
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0
    kept = {r.doc_id for r in langid.accepted(df).collect()}
    assert kept >= set(range(300)) and not kept & {1000, 1001, 1002}


def counted(text):
    """N-grams by plain loops."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter(c for w in words for c in w)
    joined = " " + " ".join(words) + " " if words else ""
    out.update(joined[i : i + 2] for i in range(len(joined) - 1))
    out.update(joined[i : i + 3] for i in range(len(joined) - 2) if joined[i + 1] != " ")
    return out


def code_of(gram):
    return int(langid.hashed(len(gram), *(np.array([0 if c == " " else ord(c)], np.uint32) for c in gram))[0])


def test_grams_and_ranks():
    for text in ("ab! a", "ДА да, 日本", "x", "1 2 é"):
        assert Counter(langid.grams(text).tolist()) == sum((Counter({code_of(g): n}) for g, n in counted(text).items()), Counter())
    assert langid.most_frequent(np.array([5, 5, 9, 7, 7, 1]), 3).tolist() == [5, 7, 1]


def test_language_equals_brute_force(spark):
    rng = random.Random(23)
    speech = {"en": "the and thing with ation ould".split(), "de": "der und schön über keit ung".split(), "ja": "ほん にち とう きょう たべ".split(), "ru": "это как для что они был".split()}
    rows = [(i, " ".join(rng.choice(speech[lang]) for _ in range(rng.randint(1, 25))), lang) for i in range(240) for lang in [rng.choice(list(speech))]]
    profile = {}
    for lang in speech:
        total = Counter()
        for i, text, own in rows:
            if own == lang and zlib.crc32(str(i).encode()) % 5:
                total.update({code_of(g): n for g, n in counted(text).items()})
        profile[lang] = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        own = [g for g, _ in sorted(Counter({code_of(g): n for g, n in counted(rows[r.doc_id][1]).items()}).items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]
        far = {lang: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) / (langid.PROFILE * len(own)) for lang, p in profile.items()}
        first, second = sorted(far.values())[:2]
        assert r.lang_pred == min(far, key=lambda x: (far[x], x)) and abs(r.distance - first) < 1e-9 and abs(r.score - (1 - first / second)) < 1e-9


def test_unlearned_languages_go(spark):
    rng = random.Random(29)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    german = "der und schön über keit ung ich nicht ein die".split()
    rows = [(i, " ".join([prose(rng, 30), "the and"][i % 3 // 2] for _ in range(1 + i % 9)), "en", i) for i in range(200)]
    rows += [(200 + i, " ".join(rng.choice(german) for _ in range(rng.randint(3, 60))), "de", i) for i in range(200)]
    rows += [(500 + i, say("kyjäövaplz", 60), None, i) for i in range(10)] + [(600, "the and", "en", 1), (601, "the and", "en", 1), (601, "the and", "en", 1)]
    kept = [r.doc_id for r in langid.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` long")).collect()]
    assert sorted(kept) == [*range(400), 600, 601, 601]


# Near duplicates ----------------------------------------------------------------------------------------------


def bag(text):
    words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "").lower()).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_shingles(spark, texts):
    import pyarrow as pa

    column = pa.array([t or "" for t in texts])
    begin, h, w = minhash.bags(column)
    for i, t in enumerate(texts):
        assert sorted(w[begin[i] : begin[i + 1]]) == sorted(bag(t).values())
    same = lambda i, j: np.array_equal(h[begin[i] : begin[i + 1]], h[begin[j] : begin[j + 1]])
    assert same(0, 4) and same(12, 13) and not same(0, 7)


def brute_classes(texts):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            inter = sum((bags[i] & bags[j]).values())
            union = sum(bags[i].values()) + sum(bags[j].values()) - inter
            if (texts[i] or "") == (texts[j] or "") or union and inter / union >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("star,block", [(2000, 512), (3, 2)])
def test_near_duplicates(spark, docs, texts, monkeypatch, star, block):
    monkeypatch.setattr(minhash, "STAR", star)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BYTES", 1 << 20 if block > 2 else 1 << 10)
    out = minhash.classes(docs).collect()
    assert len(out) == docs.count()
    wanted = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in out} == dict(enumerate(wanted))
    kept = minhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted)) and kept.columns == docs.columns


def test_near_duplicates_of_a_large_group(spark):
    """A chain of edits: each text is near to its neighbours only, and all are one class."""
    rng = random.Random(11)
    words = prose(rng, 200).split()
    texts = []
    for i in range(40):
        words = words[:]
        words[(i * 7) % 190] = f"w{i}"
        texts.append(" ".join(words))
    out = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert [out[i] for i in range(40)] == brute_classes(texts)
    assert minhash.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_frequent_shingles_decide_links_of_few_texts(spark):
    rng = random.Random(17)
    words = lambda name, n: " ".join(f"{name}x{j}" for j in range(n))
    passage = words("shared", 104)
    texts = [f"{passage} {words(f'own{i}', 10)}" for i in range(20)] + [prose(rng, 100) for _ in range(38)]
    texts += [f"{words('pair', 100)} {words(x, 3)}" for x in ("one", "two")]
    bags = [bag(t) for t in texts]
    df = Counter(g for b in bags for g in b)
    idf = {g: 1 + np.log(len(texts) / max(n, len(texts) / 1000)) / np.log(1000) for g, n in df.items()}
    wanted = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            inter, union = (sum(n * idf[g] for g, n in x.items()) for x in (bags[i] & bags[j], bags[i] | bags[j]))
            if inter / union >= 0.8:
                wanted = [wanted[j] if x == wanted[i] else x for x in wanted]
    assert wanted[:20] == list(range(20)) and wanted[59] == 58 and brute_classes(texts)[19] == 0
    out = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert [out[i] for i in range(len(texts))] == wanted


def test_texts_that_share_a_hash(spark):
    held = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (1, 11, 7), (2, 10, 8), (2, 10, 9)], "node long, node2 long, k long")
    got = {r.k: r.node for r in minhash.told_apart(held).collect()}
    assert got[8] == got[9] == 2 and got[6] == got[7] and len(set(got.values())) == 3 and 1 not in got.values()


def test_weighted_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 62, 600, dtype=np.uint64)
    w = rng.choice([1.0, 2.0, 3.0], 600)
    a, b = np.arange(0, 450), np.arange(90, 540)
    inter = w[90:450].sum()
    true = inter / (w[a].sum() + w[b].sum() - inter)
    both = minhash.samples(np.array([0, 450, 900]), np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]), 2000)
    assert abs((both[0] == both[1]).mean() - true) < 0.04


def test_recall_of_bands_at_the_threshold():
    """Pairs of a weighted similarity of 0.8 share a bucket."""
    rng = np.random.default_rng(2)
    found, pairs = 0, 400
    for _ in range(pairs):
        h = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
        w = np.repeat(rng.choice([1.0, 1.5, 2.0, 3.0], 10), 20)  # in every twenty the same weight, so that parts weigh alike
        a, b = np.arange(200) % 20 >= 2, np.arange(200) % 20 < 18
        inter = w[a & b].sum()
        assert abs(inter / (w[a].sum() + w[b].sum() - inter) - 0.8) < 1e-9
        both = minhash.band_hashes(minhash.samples(np.array([0, a.sum(), a.sum() + b.sum()]), np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]])))
        found += bool((both[0] == both[1]).any())
    assert found >= 0.975 * pairs


def test_heavy_shingles_weigh_less(spark):
    rng = random.Random(13)
    line = "one very common line of words "
    heavy = minhash.heavy_shingles(minhash.keyed(spark.createDataFrame(rows_of([line + prose(rng, 30) for _ in range(60)]), DOCS)))
    assert len(heavy[0]) >= 2 and (heavy[1] < 1.01).sum() >= 2


# Top-k --------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(400)]
    vectors += [(500, vectors[0][1], 0), (501, vectors[0][1], 0), (600, None, 0), (650, [], 0), (700, [None] * 16, 0), (750, [float("nan")] * 16, 0), (800, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, part int")
    q = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v, _ in vectors if v and v[0] is not None and np.isfinite(v).all()}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    wanted = {}
    for i in q:
        if i % 50 == 0:
            for rank, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5], 1):
                wanted[i, rank] = (j, -s)
    assert got == wanted
    assert topk.top_k(df.where("vec_id in (0, 3)")).count() == 1 and topk.top_k(df.where("false")).count() == 0


def brute_top(rows, k=5, every=50):
    q = [(n, i, [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * int(x) for x in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, i, x in q:
        if i % every == 0:
            near = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=True)))), j) for m, j, y in q if m != n and len(y) == len(x))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def test_top_k_of_large_components_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(50, [float(1 << 21)] * 4)] + [(51 + i, [float((1 << 21) - (i == j)) + i / 256 for j in range(4)]) for i in range(4)]
    rows += [(100, [1e18, 1.0, -3e30, 2.0]), (101, [1e18, 2.0, 0.0, 0.0]), (150, [1e308, -1e308, 1.0, 0.0]), (151, [0.5, 0.5, 0.5, 0.5])]
    rows += [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 22)).tolist()) for i in range(200, 260)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute_top(rows)


def test_top_k_among_copies_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PART", 2)
    monkeypatch.setattr(topk, "ASKS", 3)
    rng = np.random.default_rng(6)
    common = rng.normal(size=8).tolist()
    rows = [(i % 290, common if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(300)] + [(350, [1.0, 2.0]), (351, [2.0, 1.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute_top(rows)


# Suffix arrays ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.sampled_from([8, 11, 24]))
def test_repeats_of_a_shard(raw, length):
    data = np.frombuffer(raw * 2 if len(raw) % 2 else raw, np.uint8)
    text = data.tobytes()
    sa = suffix.suffix_array(data) if len(data) else []
    assert list(sa) == sorted(range(len(text)), key=lambda i: text[i:])
    times = Counter(text[i : i + length] for i in range(len(text) - length + 1))
    assert suffix.repeated(data, length).tolist() == [i + length <= len(text) and times[text[i : i + length]] > 1 for i in range(len(text))]
    half = len(text) // 2
    inside = {text[half + i : half + i + length] for i in range(len(text) - half - length + 1)}
    found = suffix.found_in(data[:half], data[half:], suffix.suffix_array(data[half:]) if half < len(text) else np.empty(0, int), length)
    assert found.tolist() == [i + length <= half and text[i : i + length] in inside for i in range(half)]


def brute_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("shard", "paired"), [(1 << 20, 4), (1500, 1000), (400, 1)])
def test_long_repeats_go(spark, docs, texts, shard, paired, monkeypatch):
    monkeypatch.setattr(suffix, "PAIRED", paired)
    every = [*texts, texts[2]]
    got = {r.doc_id: tuple(r)[1:5] for r in suffix.digests(docs, 120, 16, shard).collect()}
    assert got == dict(enumerate(brute_removed(every, 120)[: len(texts)]))
    kept = suffix.cleaned(docs, 120, 16, shard)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())
    assert suffix.digests(docs.where("false")).count() == 0


def test_repeats_of_400_bytes(spark, texts):
    got = {r.doc_id: tuple(r)[1:5] for r in suffix.digests(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert got == dict(enumerate(brute_removed(texts, 400)))


def test_passages_in_many_surroundings(spark, monkeypatch):
    """A hot anchor that is refined: passages of several lengths between texts of their own, some of which agree for a while."""
    monkeypatch.setattr(suffix, "PAIRED", 1)
    rng = random.Random(37)
    passage = prose(rng, 60)
    made = [prose(rng, rng.randint(1, 40)) + passage[rng.randint(0, 60) : rng.randint(200, len(passage))] + rng.choice(["same end " * 9, prose(rng, 30)]) for _ in range(60)]
    got = {r.doc_id: tuple(r)[1:5] for r in suffix.digests(spark.createDataFrame(rows_of(made), DOCS), 120, 16, 2000).collect()}
    assert got == dict(enumerate(brute_removed(made, 120)))


def contexts_of(texts, length, gram, blocks_):
    """Tasks as spans() makes them: (whether it is a pair of blocks, its table)."""
    by_anchor = {}
    for k, raw in enumerate(t.encode() for t in texts):
        found = suffix.anchors(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), length, gram)
        for _, first, last, p, a in zip(*(x.tolist() for x in found), strict=True):
            by_anchor.setdefault(a, {}).setdefault(raw[first : last + length], []).append((k, first, p))
    out = []
    for a, kinds in by_anchor.items():
        rows = [{"a": a, "own": i % blocks_, "n": len(at), "k1": at[0][0], "k2": 0, "lo": at[0][1], "p": at[0][2], "raw": raw} for i, (raw, at) in enumerate(kinds.items())]
        for b1, b2 in itertools.combinations_with_replacement(range(blocks_), 2):
            if task := [r | {"b1": b1, "b2": b2} for r in rows if r["own"] in (b1, b2)]:
                out.append((b1 != b2, pa.Table.from_pylist(task)))
    return out


@pytest.mark.parametrize("blocks_", [1, 3])
def test_only_what_may_repeat_is_sorted(blocks_):
    rng = random.Random(53)
    shared, phrase = prose(rng, 60), prose(rng, 6)
    alike = [prose(rng, rng.randint(1, 30)) + shared[rng.randint(0, 90) : rng.randint(150, len(shared))] + prose(rng, 20) for _ in range(12)]
    phrases = [prose(rng, 40) + phrase + prose(rng, 40) for _ in range(40)]  # equal for the anchor's bytes, but never for 120

    def removed(tasks):
        return {(r["k1"], x) for pair, part in tasks if part.num_rows for batch in suffix.marked(part, pair, 120) for r in batch.to_pylist() for x in range(r["lo"], r["hi"] - 119)}

    every = contexts_of([*alike, *alike[:3], *phrases], 120, 16, blocks_)
    thin = [(pair, suffix.thinned(part, 120)) for pair, part in every]
    assert removed(thin) == removed(every) != set()
    assert sum(part.num_rows for _, part in contexts_of(phrases, 120, 16, blocks_)) > 40
    assert not any(suffix.thinned(part, 120).num_rows for _, part in contexts_of(phrases, 120, 16, blocks_))


def test_parts_of_a_very_long_text(spark, docs):
    rows = suffix.keyed(docs)
    windows = lambda df: sorted((r.k1, r.k2, x, r.a) for r in df.collect() for x in range(r.lo, r.lo + r.size - 119))
    assert windows(suffix.find_anchors(rows, 120, 16, 1000)) == windows(suffix.find_anchors(rows, 120, 16))


def test_columns_whose_names_clash(spark, texts):
    rows = [(i, t, 77, 78, [1], 5, 6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k long, `__k` long, parts array<int>, K1 long, `a.b` long")
    cleaned = suffix.cleaned(df, 120, 16)
    assert cleaned.columns == df.columns and {(r.k, r.parts[0], r.K1, r["a.b"]) for r in cleaned.collect()} == {(77, 1, 5, 6)}
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and {(r.k, r["__k"]) for r in kept.collect()} == {(77, 78)}


# Vectors ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2048, 16])
def test_links_of_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 24))
    near = base[:20].repeat(3, 0) + rng.normal(size=(60, 24)) * 0.12
    crowd = base[30] + rng.normal(size=(60, 24)) * 0.1
    vectors = np.concatenate([base, near, crowd, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, t int")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    label = np.arange(len(vectors))
    for _ in range(len(vectors)):
        label = np.array([label[x].min() for x in linked])
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum() - 1, label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903))
    assert got[905].component_id == 904 and got[905].n_links == 1
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_links_of_odd_vectors_and_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1e-200, 1e-200]), (5, [2e-200, 2e-200]), (6, [1e300, 1e300]), (7, [-1.0, -1.0]), (8, [-1.0, -1.0]), (8, [-1.0, -1.0]), (None, [1.0, 0.0])]
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 1, 1), ("4", 2, 4), ("5", 2, 4), ("6", 2, 4), ("7", 2, 7), ("8", 2, 7), ("8", 2, 7), ("None", 0, None)], key=lambda x: x)


def test_counts_prune_and_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    a = embed_dedup.unit(rng.normal(size=(4000, 64)))
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * embed_dedup.unit(other)  # pairs at the threshold
    count, reach = embed_dedup.least(), embed_dedup.window()
    near = np.abs(embed_dedup.projected(a).astype(int) - embed_dedup.projected(b).astype(int)) <= reach
    far = np.abs(embed_dedup.projected(a).astype(int) - np.roll(embed_dedup.projected(b), 1, 0).astype(int)) <= reach
    assert (near.sum(1) >= count).mean() >= 0.998 and (far.sum(1) >= count).mean() < 0.001
    for n in (10, 10_000, 100_000):
        width, tables = embed_dedup.parting(n)
        met = (embed_dedup.sides(a, width, tables) == embed_dedup.sides(b, width, tables)).any(1)
        assert met.mean() >= 0.995
    p = embed_dedup.projected(np.concatenate([a[:150], b[:150]]))
    hits = np.abs(p[:, None].astype(int) - p.astype(int)) <= reach
    wanted = {(i, j) for i, j in zip(*np.nonzero(hits.sum(2) >= count), strict=True) if i < j}
    assert {x for lo in range(0, 300, 128) for x in zip(*embed_dedup.colliding(p, lo, min(lo + 128, 300), reach, count), strict=True)} == wanted


def test_links_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BUCKET", 20)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 32))
    vectors = np.concatenate([base, base[:100] + rng.normal(size=(100, 32)) * 0.2, base[:50] + rng.normal(size=(50, 32)) * 0.3]).astype(np.float32)
    u = embed_dedup.unit(vectors.astype(float))
    linked = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()}
    assert sum(got.values()) >= 0.99 * linked.sum() and all(got[i] <= linked[i] for i in got) and linked.sum() > 100


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19] + [(5, 5), (7, 3)], "a long, b long")
    got = {r.node: r.label for r in common.components(edges).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)}
    assert common.components(edges.where("false")).count() == 0


# Pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [prose(rng, 150) for _ in range(30)]
    shared = prose(rng, 120)
    texts += [texts[0], texts[1] + " more", prose(rng, 60) + " " + shared, prose(rng, 60) + " " + shared, "12 34", None]
    spark.createDataFrame([r[:5] for r in rows_of(texts)], DOCS.rsplit(",", 1)[0]).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [i for i, c in enumerate(brute_classes(texts)) if c == i and i < 34]
    left = {}
    cut = brute_removed([texts[i] for i in kept], 400)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in rows}) == kept
    for r in rows:
        left[r.doc_id] = left.get(r.doc_id, 0) + r.length
    for i, (_, removed, _, _) in zip(kept, cut, strict=True):
        assert (left[i] == len(encode(texts[i])) + 1) == (removed == 0)
    assert any(c[1] for c in cut) and [name for name, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(53)
    passage = " ".join(prose(rng, 200).split()[:51])
    texts = [prose(rng, 100) + " " + passage + " " + prose(rng, 100) for _ in range(3)] + [prose(rng, 200)]
    assert 200 <= len(passage) < 400
    stage = dict(corpus_pipeline.STAGES)["suffix_array_dedup"]
    left = {r.doc_id: r.text for r in stage(spark, spark.createDataFrame(rows_of(texts), DOCS), "").collect()}
    assert all(passage not in left[i] and len(left[i]) < len(texts[i]) for i in range(3)) and left[3] == texts[3]


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, ties, repeated rows, a very long text, and names that clash."""
    import corpus_pipeline

    rng = random.Random(47)
    long = prose(rng, 40_000)
    kind = "doc_id long, text string, lang string, source string, n_chars long, k long, `a.b` string, parts array<int>, label string"
    rows = [(1, long, "en", "s", len(long)), (2, prose(rng, 80), None, None, None), (None, prose(rng, 60), "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", None), (5, "a b c", "en", "s", 5), (5, "a b c", "en", "s", 5), (6, "12 !", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, i, "x", [i], "y") for i, r in enumerate(rows)], kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), "").collect() == [] and stage(spark, docs.where("false"), "").columns == docs.columns
        docs, _ = common.written(stage(spark, docs, ""), f"odd-{name}")
        assert docs.dtypes[:5] == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == {1, 2, None, 5} and docs.count() == 4 and kept[1].text == long and kept[2].lang is None and all(r["a.b"] == "x" and r.parts == [r.k] for r in kept.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == set(kept) and corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), "").count() == 0


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))

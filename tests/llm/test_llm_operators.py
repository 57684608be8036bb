"""The training-data operators against brute force, round trips and held-out labels, with odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from covermill.llm import bpe, chat_format, decontaminate, html_content, language_id, library_tokens, line_dedup, near_copies, pieces, quality_rules, queries, simhash, token_counts, token_files
from covermill.llm.components import components
from covermill.llm.library_tokens import tokenizer_path
from covermill.llm.pieces import safe_chunks, safe_pieces

ODD = [None, "", " ", "a", "  two  spaces ", "line\n\nline\n", "x<|endoftext|> y", "Ⅷ² 漢字 \U0001f600\u3000é", "a" * 3000, "</s>[INST] \\[/INST] <\\|im_end|>", "same text here", "same text here", "tab\tnbsp\xa0end\r\n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with those that the operators add."""
    rows = [(i if i != 3 else None, t, "z", i, 5) for i, t in enumerate(ODD)] + [(10, ODD[10], "z", 10, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, _id int")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def empty(df):
    return df.where("false")


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_join_back():
    random.seed(2)
    for _ in range(2000):
        text = "".join(random.choices([" ", "  ", "\n", "a", "é.", "\t", "\x85", "\u3000", "漢"], k=random.randint(0, 12)))
        assert " ".join(safe_pieces(text)) == text
        assert "".join(" " * f + t for t, f in safe_chunks(text, 3)) == text


def test_token_counts(spark, odd, small, library):
    for df in (odd, small):
        got = token_counts.with_token_counts(df).collect()
        assert len(got) == df.count()
        for r in got:
            n = len(library_ids(library, r.text))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 1024)
    assert token_counts.with_token_counts(empty(odd)).count() == 0


def test_bpe_is_exact_and_decodes(spark, odd, small, library):
    for df in (odd.drop("ids"), small):
        for r in bpe.round_trip(df).collect():
            assert r.ids == library_ids(library, r.text)
            assert r.decoded == (r.text or "")
    assert bpe.round_trip(empty(odd)).count() == 0
    strange = spark.createDataFrame([([255, 50256, 130],), ([],), (None,)], "ids array<int>")
    decoded = [r.decoded for r in bpe.with_decoded(strange).collect()]
    assert decoded[0] == library.decode([255, 50256, 130], skip_special_tokens=False) and decoded[1:] == ["", None]


def test_backtracking_on_random_letters(library):
    random.seed(4)
    encoder = bpe.BacktrackingBpe(tokenizer_path("byte_bpe_50k.json"))
    texts = ["".join(random.choices("abcdeinorst", k=random.randint(1, 40))) for _ in range(3000)] + ["ab" * 2000, "=" * 999, "\n" * 300]
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(data, np.int32).tolist() == library_ids(library, text)


def test_token_files(spark, odd, small, library):
    path = token_files.write_token_files(small, token_files.new_folder(spark, "t"))
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in small.collect()}
    start = 0
    for r in rows:
        ids = [*library_ids(library, texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert len(rows) == len(texts)
    some = token_files.read_token_files(spark, path, [rows[3].doc_id, rows[7].doc_id, -1]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == [(rows[k].doc_id, rows[k].start) for k in (3, 7)]
    # odd rows: every row comes back, in order, nulls first
    path = token_files.write_token_files(odd, token_files.new_folder(spark, "t"))
    back = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None, 0, 1, 2, *range(4, 11), 10, 11, 12]
    assert token_files.read_token_files(spark, token_files.write_token_files(empty(odd), token_files.new_folder(spark, "t"))).count() == 0


def test_language_id(spark, small, odd):
    rows = queries.op2_language_id(spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in small.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    samples = [("de", " der hund und die katze"), ("en", " the dog and the cat")]
    got = {r.text: (r.lang_pred, r.score) for r in language_id.with_language(odd, samples).collect()}
    assert got[None] == got[""] == got[" "] == ("und", 0.0) and len(got) == len(set(ODD))
    assert language_id.with_language(odd, []).where("lang_pred <> 'und'").count() == 0
    assert language_id.learn(empty(small)) == []


def test_longest_matches():
    text = " banana bandana"
    step = language_id.suffix_automaton(text)
    for word in (" banana", "nanab", "xyz", " bandanana", "aaa"):
        n, at = 0, 0
        while at < len(word):
            size = 1
            while at + size < len(word) and word[at : at + size + 1] in text:
                size += 1
            n, at = n + 1, at + size
        assert language_id.phrases(step, word) == n


def slow_tiles(item, doc, m):
    """Greedy string tiling by trying every pair of places."""
    mine, theirs, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and p + n not in mine and t + n not in theirs:
                    n += 1
                if (-n, p, t) < (-best[0], best[1], best[2]):
                    best = (n, p, t)
        n, p, t = best
        if n < m:
            return sorted(tiles)
        tiles.append((t, p, n))
        mine.update(range(p, p + n))
        theirs.update(range(t, t + n))


def test_tiling_equals_brute_force():
    random.seed(6)
    hashes = decontaminate.WordHashes()
    for _ in range(60):
        item, doc = (random.choices("abc", k=random.randint(4, 25)) for _ in range(2))
        index = decontaminate.SeedIndex([(1, " ".join(item))], 3)
        found = index.find(hashes(" ".join(doc)), 0.0)
        assert sorted(found[0][3] if found else []) == slow_tiles(item, doc, 3)


def test_decontamination_query_equals_brute_force(spark):
    found = {(r.doc_id, r.item_id): (r.n_item_words, r.n_covered, r.n_tiles) for r in queries.op3_decontaminate(spark, SMALL).collect()}
    docs = [(r.doc_id, decontaminate._WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").collect()]
    items = {(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    m, want = decontaminate.MIN_TILE, {}
    for doc_id, doc in docs:
        windows = {tuple(doc[i : i + m]) for i in range(len(doc) - m + 1)}
        for item_id, text in items:
            item = decontaminate._WORD.findall(text.lower())
            if any(tuple(item[i : i + m]) in windows for i in range(len(item) - m + 1)):
                tiles = slow_tiles(item, doc, m)
                covered = sum(n for _, _, n in tiles)
                if covered >= decontaminate.MIN_COVERAGE * len(item):
                    want[doc_id, item_id] = (len(item), covered, len(tiles))
    assert want and found == want


def test_decontamination_of_a_repeated_template():
    template = "the answer to the question is one of these :"
    items = [(i, f"{template} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i}") for i in range(4000)]
    index, hashes = decontaminate.SeedIndex(items, 5), decontaminate.WordHashes()
    text = " x ".join([template] * 2000 + [items[7][1], items[3999][1]])
    tracemalloc.start()
    found = index.find(hashes(text), 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(f[0], f[2]) for f in found] == [(7, 20), (3999, 20)]
    assert peak < 20 << 20


def test_words_of_scripts_without_spaces():
    item = "北京是中华人民共和国的首都"
    index, hashes = decontaminate.SeedIndex([(1, item)], 5), decontaminate.WordHashes()
    assert [f[:3] for f in index.find(hashes(f"前文。{item}，后文 and 12 words"), 0.5)] == [(1, 13, 13)]
    assert index.find(hashes("上海是中国的城市"), 0.5) == []
    assert decontaminate._WORD.findall("one_two 北京2008 café") == ["one", "two", "北", "京", "2008", "café"]


def test_marks_without_a_letter_have_no_language():
    assert language_id._RUN.findall("\u0301\u0302 \u0301 12") == []
    assert language_id._RUN.findall("\u0301a\u0301b c1") == ["\u0301a\u0301b", "c"]


def test_decontamination(spark, odd):
    item = "one two three four five six seven eight nine ten eleven twelve"
    swapped = "so: Seven, eight nine TEN eleven twelve! and then one two three four five six."
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, swapped), (3, "one two three four and more"), (4, None), (5, ""), (6, f"x {item} y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (None, None), (9, "")], "item_id long, text string")
    for size in (1 << 20, 150):  # in one block and in several
        pairs = decontaminate.leaked_pairs(docs, bench, block_bytes=size).collect()
        assert sorted((r.doc_id, r.item_id, r.n_covered) for r in pairs) == [(1, 7, 12), (2, 7, 12), (6, 7, 12)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaked(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.drop_leaked(odd, empty(bench)).count() == odd.count()
    assert decontaminate.leaked_pairs(empty(odd), bench).count() == 0


def test_html_content(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = html_content.learn(pages)
    import html

    for r in html_content.with_main_text(pages, weights).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert (r.text, r.n_chars) == (want, len(want))
    page = '<nav><a>x</a></nav><div class="cookie-notice">We use it</div><h1>T &amp; m</h1><p>One <b>t</b>wo.<p>Five<div id=ad>buy</div> six &#233;</p><!-- c --><script>var a="<p>no</p>"</script><form>f</form><div class="comments"><p>I disagree a lot</div><footer>c</footer>'
    cases = [(1, page), (2, None), (3, ""), (4, "<p>a < b"), (5, "<p" * 5000), (5, '<a b="' * 500)]
    df = spark.createDataFrame(cases, "page_id long, html string").withColumn("text", F.lit("old"))
    got = [r.text for r in html_content.with_main_text(df, weights).orderBy("page_id").collect()]
    assert got[:4] == ["T & m One two. Five six é", "", "", "a < b"]
    assert html_content.with_main_text(empty(df), {}).count() == 0 and html_content.learn(empty(df)) == {}


def slow_dedup(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    held = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, text in rows:
        cut = (text or "").split("\n")
        kept = [x for x in cut if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and i != max(h for h in held[key(x)] if h is not None))]
        out.append((i, len(cut), len(cut) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, odd):
    long, other = "This line is found in many texts", "  another LINE of many texts É "
    rows = [(1, f"{long}\nx"), (2, f"y\n {long.upper()}\t\n{long}"), (3, f"{long}\n{long}"), (4, other), (5, other.lower()), (6, None), (7, ""), (8, f"{other}\n"), (9, "short"), (10, "short"), (11, "short"), (2, long), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("old"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == slow_dedup(rows)
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(empty(odd)).count() == 0


def test_no_column_is_lost(spark, small):
    """Columns named as what the operators work with come out as they went in."""
    names = "__lang __measures __both __hash __row __kept_id __kept_row __MEASURES_".split()
    docs = small.limit(5).select("doc_id", "text", "lang", *[F.lit(n).alias(n) for n in names])
    samples = language_id.learn(docs)
    done = [
        language_id.with_language(docs, samples),
        quality_rules.with_quality(docs),
        bpe.round_trip(docs),
        simhash.drop_near_duplicates(docs),
        decontaminate.with_leaks(docs, spark.createDataFrame([(1, "an item of five words more")], "item_id long, text string")),
    ]
    for df in done:
        assert set(docs.columns) <= set(df.columns)
        assert {tuple(r[n] for n in names) for r in df.select(*names).collect()} == {tuple(names)}


def test_chat_layouts(spark):
    records = [
        '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}',
        '{"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "do", "input": "this", "output": "done"}',
        '{"instruction": "do", "input": null, "output": "done"}',
        '{"prompt": "p", "completion": "c"}',
        '{"response": "c", "prompt": "p", "system": ""}',
        '{"unknown": 1}',
        None,
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(records)], "i int, json string").withColumn("record", F.parse_json("json"))
    got = [(r.layout, r.turns and [(t.role, t.text) for t in r.turns]) for r in chat_format.canonical_turns(df).drop("record").orderBy("i").collect()]
    assert got[0] == ("messages", [("system", "s"), ("user", "u"), ("assistant", "a")])
    assert got[1] == ("conversations", [("user", "u"), ("assistant", "a")])
    assert got[2][1] == [("user", "do\nthis"), ("assistant", "done")] and got[3][1] == [("user", "do"), ("assistant", "done")]
    assert got[4][1] == [("user", "p"), ("assistant", "c")] and got[5][1] == [("user", "p"), ("assistant", "c")]
    assert got[6] == got[7] == (None, None)


def test_chat_records_of_all_layouts(spark):
    """Every layout through the formatter, with fields it doesn't know, no turns, and several records to a key."""
    records = [
        (1, 0, '{"id": 7, "messages": [{"role": "user", "content": "u", "name": "x"}, {"role": "assistant", "content": "a</s>"}], "prompt": "u", "source": {"a": [1]}}', "messages", [("user", "u"), ("assistant", "a</s>")]),
        (2, 0, '{"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a", "weight": 1}], "id": "c"}', "conversations", [("user", "u"), ("assistant", "a")]),
        (3, 0, '{"instruction": "do", "input": "this", "output": "done", "text": "all"}', "instruction_input", [("user", "do\nthis"), ("assistant", "done")]),
        (4, 0, '{"instruction": "do", "output": null}', "instruction", [("user", "do"), ("assistant", "")]),
        (5, 0, '{"prompt": "p", "completion": "c", "n": 1}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        (6, 0, '{"prompt": "p", "response": "c"}', "prompt_response", [("user", "p"), ("assistant", "c")]),
        (7, 0, '{"prompt": "p", "response": "c", "system": "s"}', "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        (8, 2, '{"role": "user", "text": "second", "turn": 9}', "turn_row", [("user", "second")]),
        (8, 1, '{"prompt": "first", "response": "r"}', "prompt_response", [("user", "first"), ("assistant", "r")]),
        (9, 0, '{"messages": [], "id": 1}', "messages", []),
        (10, 0, '{"messages": "text"}', None, None),
        (11, 0, '{"messages": [{"role": "user"}]}', None, None),
        (12, 0, None, None, None),
        (13, 0, "[1]", None, None),
        (None, 0, '{"prompt": "p", "response": "c"}', "prompt_response", [("user", "p"), ("assistant", "c")]),
        (None, 0, '{"prompt": "p", "response": "c"}', "prompt_response", [("user", "p"), ("assistant", "c")]),
    ]
    df = spark.createDataFrame([r[:3] for r in records], "conv_id long, n int, json string").withColumn("record", F.parse_json("json"))
    got = chat_format.canonical_turns(df).drop("record").collect()
    named = lambda turns: turns if turns is None else [(t[0], t[1]) for t in turns]
    assert sorted(map(repr, ((r.conv_id, r.n, r.json, r.layout, named(r.turns)) for r in got))) == sorted(map(repr, records))
    turns, learned = chat_format.read_turns()
    out = {r.conv_id: r for r in chat_format.format_records(df, order="n").select("conv_id", turns.alias("t"), learned.alias("l")).collect()}
    want = {}
    for c, _, _, _, t in sorted(records, key=lambda r: r[1]):
        want.setdefault(c, []).extend(t or [])
    assert {c: named(r.t) for c, r in out.items()} == want
    assert all(r.l == "".join(t for role, t in want[c] if role == "assistant") for c, r in out.items())
    assert chat_format.format_records(empty(df)).count() == 0


def test_chat_format_reads_back(spark):
    texts = [*ODD, *chat_format.CONTROL, *("<\\" * 2 + x[1:] for x in chat_format.CONTROL), "<<SYS>><</SYS>>", "\\n", "[\\\\INST]"]
    roles = ["user", "assistant", None, "a\nb", "a\\nb", "\\", "<|im_end|>"]
    rows = [(k % 5 if k % 5 else None, k // 5 if k != 12 else None, roles[k % len(roles)], t, 1) for k, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    turns, learned = chat_format.read_turns()
    got = {r.conv_id: r for r in chat_format.format_conversations(df).select("conv_id", turns.alias("t"), learned.alias("l"), "formatted", "loss_mask").collect()}
    want = {}
    for c, turn, role, text, _ in rows:
        want.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, r in got.items():
        assert sorted((x.role, x.text) for x in r.t) == sorted((a, b) for _, _, a, b in want[c])
        assert r.l == "".join(x.text for x in r.t if x.role == "assistant")
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted) and r.formatted.count(chat_format.TURN_OPEN) == len(r.t)
    assert chat_format.format_conversations(empty(df)).count() == 0


def slow_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    marked = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark, odd, small):
    for df in (odd, small):
        for r in quality_rules.with_quality(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_quality(r.text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = quality_rules.with_quality(small).where("not base_failed").join(labels, "doc_id")
    assert judged.where("(quality = 1) <> kept").count() == 0
    assert quality_rules.keep_good(small).columns == small.columns and quality_rules.keep_good(empty(odd)).count() == 0
    none = quality_rules.with_quality(small, lang="lang", bands={"en": (9.0, 9.0, 0.0, 0.0, 99.0)})
    assert none.where("lang = 'en' and kept").count() == 0 and none.where("kept").count() > 0


def slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, odd, small):
    for df in (small.limit(80), odd):
        rows = df.collect()
        prints = [slow_fingerprint(r.text) for r in rows]
        label = list(range(len(rows)))
        for _ in rows:
            for i, a in enumerate(prints):
                for j, b in enumerate(prints):
                    if (a ^ b).bit_count() <= 3:
                        label[i] = label[j] = min(label[i], label[j])
        first = {}
        for r, x in zip(rows, label, strict=True):
            if r.doc_id is not None:
                first[x] = min(first.get(x, r.doc_id), r.doc_id)
        table = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()), key=str)
        assert got == sorted(((r.doc_id, f"{p:016x}", first.get(x)) for r, p, x in zip(rows, prints, label, strict=True)), key=str)
        kept = simhash.drop_near_duplicates(table).collect()
        assert len(kept) == len(set(label))
    assert simhash.near_duplicates(empty(odd)).count() == 0


@pytest.mark.parametrize("crowd", [8, 512])
def test_simhash_links_of_a_crowd(spark, crowd):
    random.seed(3)

    def near(base, k):
        for b in random.sample(range(64), k):
            base ^= 1 << b
        return base

    centre = random.getrandbits(64)
    prints = sorted({near(centre, random.randint(0, 4)) for _ in range(150)} | {random.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = {(min(signed[i], signed[j]), max(signed[i], signed[j])) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    nodes = spark.createDataFrame([(x,) for x in signed], "f long")
    assert {(r.a, r.b) for r in simhash.links(nodes, token_files.new_folder(spark, "l"), crowd=crowd).collect()} == want


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(path, token_files.new_folder(spark, "c")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_pipeline(spark, small, library):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = [(r.doc_id, r.text) for r in quality_rules.with_quality(small).where("kept").collect()]
    docs = [(i, text) for i, _, _, text in slow_dedup(docs)]
    words = [(i, t, re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t))) for i, t in sorted(docs)]
    prints = [(i, t, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()) for i, t, w in words]
    group = {i: i for i, _, _ in prints}
    for _ in range(4):
        for i, _, a in prints:
            for j, _, b in prints:
                if len(a & b) >= 0.8 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    bench = decontaminate.SeedIndex([(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()], decontaminate.MIN_TILE)
    hashes = decontaminate.WordHashes()
    want = {i: library_ids(library, t) for i, t, _ in prints if group[i] == i and not bench.find(hashes(t), decontaminate.MIN_COVERAGE)}
    assert {r.doc_id: r.ids for r in rows} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_pipeline_stages_with_odd_rows(spark, odd, tmp_path):
    """An empty table, and columns named as what the stages work with, go through the whole pipeline."""
    good = " ".join(f"{w} word" for w in "the of and to in that is was for on are with as his they at be this from have".split())
    names = "row held text2 leaks script kept lang2 n_lines n_dropped kept_text _row _cut _drop _id __row __measures f bands label g ids decoded".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, "en", "s", 1, *names) for i, t in enumerate([*ODD, f"{good}\nanother line of its own {good.upper()}", None])]
    df = spark.createDataFrame(rows, schema)
    for name, part in (("all", df), ("none", df.where("false"))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "an item of words that nobody has seen before"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == df.columns, stage_name
            assert all(tuple(r)[5:] == tuple(names) for r in out.collect())
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == sum(1 for r in quality_rules.with_quality(part.select("doc_id", "text")).where("kept").collect())


def test_crowds_lose_no_link(spark):
    """A template that hundreds share: planted pairs at 0.80, all others just below."""
    random.seed(5)
    template = [f"t{i}" for i in range(404)]
    rows = []
    for k in range(150):
        own = [f"p{k}x{i}" for i in range(4)]
        for side in range(2):
            rows.append((len(rows), " ".join([*template, *own, *[f"s{k}y{side}z{i}" for i in range(47)]])))
    sets = [set(near_copies.shingles(t.encode()).tolist()) for _, t in rows]
    j = lambda a, b: len(a & b) / len(a | b)
    assert all(j(sets[2 * k], sets[2 * k + 1]) >= 0.8 for k in range(150)) and j(sets[0], sets[2]) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (8, 256):
        label = {r.doc_id: r.label for r in near_copies.near_copies(docs, crowd=crowd).collect()}
        linked = sum(label[2 * k] == label[2 * k + 1] for k in range(150))
        assert linked == 150 and len(set(label.values())) == 150


def test_links_of_a_group():
    random.seed(4)
    for _ in range(200):
        pool = np.arange(random.choice([5, 30, 200]), dtype=np.uint64)
        sets = [np.unique(np.array(random.sample(pool.tolist(), random.randint(0, len(pool))), dtype=np.uint64)) for _ in range(random.randint(0, 30))]
        least = random.choice([0.2, 0.5, 0.8])
        want, got = list(range(len(sets))), list(range(len(sets)))
        pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (len(np.union1d(a, b)) == 0 or len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= least)]
        for label, links in ((want, pairs), (got, near_copies.links_of(sets, least))):
            for i, j in links:
                x, y = label[i], label[j]
                label[:] = [min(x, y) if v in (x, y) else v for v in label]
        assert got == want


def test_digest_queries(spark, small, library):
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in queries.op4_bpe(spark, SMALL).collect():
        ids = library_ids(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    start = 0
    for r in queries.op1_token_files(spark, SMALL).orderBy("doc_id").collect():
        ids = [*library_ids(library, texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_near_copies_reach_the_similarity(spark):
    random.seed(8)
    texts = []
    for _ in range(12):
        base = [f"w{random.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 3, 4, 6, 9):  # similarity 0.95 to 0.6
            copy = list(base)
            for p in random.sample(range(200), edits):
                copy[p] = f"x{random.randrange(5000)}"
            texts.append(" ".join(copy))
    texts += ["", " \n", "one two", "One  two", "one two three"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))
    for _ in range(8):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    rows = [*enumerate(texts), (200, texts[3]), (None, texts[7]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(set(label) - {label[7]})
    for crowd in (2, 32):
        kept = [r.doc_id for r in near_copies.drop_near_copies(docs, crowd=crowd).collect()]
        assert sorted(x for x in kept if x is not None) == want and kept.count(None) == 1
    one = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 200"), SMALL).collect()]
    assert sorted(one) == sorted(set(label))
    assert near_copies.drop_near_copies(empty(docs)).count() == 0


def test_little_text_wins_nothing(small):
    rows = small.where(F.length("text") > 200).select("lang", "text").collect()
    held, learned = rows[::4], [r for i, r in enumerate(rows) if i % 4]
    by_lang = {}
    for r in learned:
        by_lang.setdefault(r.lang, []).append(r.text)
    samples = [(name, language_id.training_text(texts, language_id.SAMPLE_CHARS)) for name, texts in sorted(by_lang.items())]
    for rare in (" a", " ok", " ja und nein", " this is a page"):
        got = language_id.Model([("aa", rare), *samples]).predict([r.text for r in held])
        assert sum(x == r.lang for (x, _), r in zip(got, held, strict=True)) >= 0.97 * len(held)


def test_every_language_is_learned(spark):
    letters = [chr(0x4E00 + 40 * i) for i in range(80)]
    docs = spark.createDataFrame([(c * 3 + f" {c}x", f"l{i:02}") for i, c in enumerate(letters) for _ in range(1 + (i < 64))], "text string, lang string")
    samples = language_id.learn(docs)
    assert [name for name, _ in samples] == [f"l{i:02}" for i in range(80)]
    got = language_id.with_language(docs.distinct(), samples).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_html_names_hide_no_content(spark):
    weights = html_content.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))
    story = "<p>One two three four five six.</p><p>Seven eight nine ten.</p>"
    want = "One two three four five six. Seven eight nine ten."
    for name in ("has-sidebar", "no-sidebar", "header-fixed", "menu-open", "search-page", "sidebar", "search"):
        for inner in (f"<article>{story}</article>", f"<main><div class='{name}'>{story}</div></main>" if "-" in name else story):
            assert html_content.main_text(f'<nav>a b</nav><div class="x {name}">{inner}</div><footer>c</footer>', weights) == want
    assert html_content.main_text(f"<form>{story}<select><option>q</select></form>", weights) == want
    inside = f'<article><div class="article-header"><h1>Title</h1></div><h2 id="related-work">Old</h2><h2 id="search-algorithms">New</h2>{story}<div class="ad">buy</div></article>'
    assert html_content.main_text(inside, weights) == f"Title Old New {want}"
    assert html_content.main_text(f'<article>{story}</article><div id="comments"><article>I disagree</article></div>', weights) == want


def test_html_graphics_leave_their_paragraph_open(spark):
    """What stands inside a line doesn't end its paragraph, and names that the contract doesn't list hide nothing in an article."""
    weights = html_content.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))
    page = "<nav>a b</nav><article><p>One two three four five six.</p>{}</article><footer>c</footer>"
    start = "One two three four five six."
    for part, text in (
        *((f"<p>Area <{x}><g>x</g></{x}> end</p>", "Area end") for x in ("svg", "button", "select", "iframe")),
        *((f"<p>Area <{x}>x</{x}> end</p>", "Area x end") for x in ("math", "object", "canvas", "video", "audio", "map")),
        *((f'<section class="{x}">we share data</section><p>so do others</p>', "we share data so do others") for x in ("share", "search", "related", "hidden")),
        ("<div hidden>shown later</div><p>and more</p>", "shown later and more"),
        ("<dialog>he said</dialog><p>and more</p>", "he said and more"),
        ('<div class="ad">buy</div><p>and more</p>', "and more"),
        ('<form>name</form><p>and more</p>', "and more"),
    ):
        assert html_content.main_text(page.format(part), weights) == f"{start} {text}", part


def test_html_run_is_whole():
    menu = "<ul>\n<li><a>Home</a></li>\n<li><a>News</a></li>\n</ul>\n"
    sample = f"<body>\n<div>\n{menu}</div>\n<article>\n<p>one two three four five six seven eight nine ten</p>\n<p>more <a>words</a> here</p>\n</article>\n<table>\n<tr>\n<td>x</td>\n</tr>\n</table>\n</body>"
    counts = html_content.Counter()
    for _ in range(30):
        counts.update(html_content.count_features(sample))
    weights = html_content.learn_weights(counts)
    assert all(n for n in counts.values())
    p = "<p>This is a long paragraph of plain words that stands there for its score alone.</p>"
    text = "This is a long paragraph of plain words that stands there for its score alone."
    parts = ("bare text", "<div>bare in a block</div>", "<ul>\n<li>an item</li>\n<li><a>linked item</a></li>\n</ul>", "<table>\n<tr>\n<td>cell</td>\n</tr>\n</table>", "<p>see <a>this link</a> now</p>")
    for part in parts:
        plain = " ".join(re.sub("<[^>]*>", "", part).split())
        got = html_content.main_text(f"<body>\n{menu}<article>\n{p}\n{part}\n{p}\n</article>\n{menu}</body>", weights)
        assert got == f"{text} {plain} {text}"


def test_blocks_are_read_in_bounded_parts():
    """Texts that repeat themselves compress a thousandfold; their ids don't come back all at once."""
    data = np.zeros(50_000, dtype="<u2").tobytes()
    frame = token_files.zstandard.ZstdCompressor().compress(data)
    n = 40
    block = {"start": 7, "width": 2, "doc_ids": list(range(n)), "lengths": [50_000] * n, "offsets": [i * len(frame) for i in range(n)], "payload": frame * n, "wanted": None}
    types = {"start": pa.int64(), "width": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "offsets": pa.list_(pa.int32()), "payload": pa.binary(), "wanted": pa.list_(pa.int64())}
    batch = pa.RecordBatch.from_pylist([block, {**block, "wanted": [n]}], pa.schema(list(types.items())))
    parts = list(token_files._frames(b"")(iter([batch])))
    assert max(p.nbytes for p in parts) < 5 << 20 and len(parts) > 2
    rows = pa.Table.from_batches(parts).to_pylist()
    assert [(r["doc_id"], r["start"], r["n_tokens"], len(r["ids"])) for r in rows] == [(i, 7 + 50_000 * i, 50_000, 200_000) for i in range(n)]


def test_a_piece_of_one_word_is_kept_once(library):
    encoder = bpe.BacktrackingBpe(tokenizer_path("byte_bpe_50k.json"))
    text = "strangewords alone, Ünbekannte Wörter (strangewords) it's strangewords, Wörter."
    assert np.frombuffer(encoder.encode([text])[0], dtype=np.int32).tolist() == library_ids(library, text)
    assert "Ünbekannte" in encoder.cache_later and " Ünbekannte" not in encoder.cache_words


def test_simhash_proposes_near_copies(spark, monkeypatch):
    """Without any band, copies of close fingerprints are still found, and only where their shingles agree."""
    random.seed(3)
    texts = []
    for _ in range(5):
        base = [f"w{random.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(base), "\n ".join(base).upper()]
    prints = [simhash.fingerprint(t.encode(), near_copies.WORDS) for t in texts]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in zip(prints[::2], prints[1::2]))
    monkeypatch.setattr(near_copies, "_band_lists", lambda words: lambda column: F.array().cast("array<long>"))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == [0, 2, 4, 6, 8]


def test_near_copies_keep_to_their_memory(monkeypatch):
    """A stage without a model gives back the one before, each shingle is hashed once, and a group is counted in bounded parts."""
    pieces.one_per_worker(("test",), lambda: bytearray(1 << 20))
    texts = ["", "a", "B c  d e f g h", " ".join(f"w{i * i % 977}" for i in range(9000))]
    find = near_copies._signatures(near_copies.WORDS).func
    got = pa.concat_arrays(list(find(iter([pa.array(texts)])))).to_pylist()
    assert not pieces._HELD
    assert [r["print"] for r in got] == [simhash.fingerprint(t.encode(), near_copies.WORDS) for t in texts]
    hashes = [np.unique(near_copies.shingles(t.encode())) for t in texts]
    want = [(near_copies._FACTORS * h + near_copies._TERMS).min(axis=1, initial=np.iinfo(np.uint64).max).view(np.int64).tolist() for h in hashes]
    assert [r["least"] for r in got] == want
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 64, 500 * k, dtype=np.uint64)])) for k in range(40)]
    tracemalloc.start()
    links = near_copies.links_of(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    monkeypatch.setattr(near_copies, "_VALUES", 1 << 40)
    assert links == near_copies.links_of(sets, 0.8) and links


def test_known_pieces_are_not_gathered_again(library, monkeypatch):
    """Only pieces that the cache doesn't hold are looked at twice, and a change of its generation loses none."""
    encoder = library_tokens.LibraryEncoder(tokenizer_path("byte_bpe_50k.json"))
    encoder.later.size = 4
    wanted, fill = [], encoder.later.fill
    monkeypatch.setattr(encoder.later, "fill", lambda keys, make: (wanted.append(set(keys)), fill(keys, make)))
    texts = ["one two three four five six", "x two six seven", "x two eight", "one two three x"]
    for text in texts:
        assert np.frombuffer(encoder.encode([text])[0], dtype=encoder.dtype).tolist() == library_ids(library, text)
    assert wanted[0] == {"two", "three", "four", "five", "six"} and wanted[1] == {"seven"}


def test_known_words_come_back_with_other_marks(library, monkeypatch):
    """A word that the library has encoded isn't given to it again for the marks around it, and the ids stay the library's."""
    encoder = library_tokens.LibraryEncoder(tokenizer_path("byte_bpe_50k.json"))
    given, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: (given.extend(texts), encode(texts))[1])
    encoder.encode(["so strangewords été stand"])
    given.clear()
    for texts in (["so strangewords, été! no strangewords", None, "x strangewords.\nIt strangewords***"], ["a strangewords\n\n", "a strangewords<|endoftext|> strangewords's"]):
        for text, data in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(data, encoder.dtype).tolist() == library_ids(library, text)
    assert not any("strangewords" in x and "<|" not in x for x in given)


def test_pieces_of_many_texts(library, monkeypatch):
    """Texts are cut together as each is alone, whatever white space, marks, scripts and lengths they mix."""
    random.seed(6)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", "\x85", "\xa0", "\u3000", "a", "Été.", "漢", "'s", "'", "12", "²", "½", "ª", "\xad", "\x00", "\x1c", "<|endoftext|>", "<|", "ɏ", "ɐ", "%%%", " word"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(3000)]
    texts += [f"q x{chr(k)}1{chr(k)}{chr(k)} {chr(k)}y.{chr(k)}" for k in range(1, 0x300)]
    assert pieces.safe_lists(pa.array(texts, pa.string())).to_pylist() == [safe_pieces(t) for t in texts]
    texts += ["Lorem ipsum, dolor.\nSit " * 60_000, ""]
    monkeypatch.setattr(library_tokens, "_AT_ONCE", 1 << 20)
    encoder = library_tokens.LibraryEncoder(tokenizer_path("byte_bpe_50k.json"))
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(data, encoder.dtype).tolist() == library_ids(library, text)
    assert encoder.encode([]) == []

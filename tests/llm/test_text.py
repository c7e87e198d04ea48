from __future__ import annotations

import hashlib
import random
import re
import textwrap
import time
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessitura.llm import bpe, decontaminate, licenses, minhash, pii, token_counts, toxicity, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, key long, w string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "w", 0.0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def odd_texts():
    r = random.Random(1)
    ranges = [(32, 126), (160, 0x2FF), (0x400, 0x4FF), (0x4E00, 0x4FFF), (0x1F600, 0x1F640)]
    mixed = ["".join(chr(r.randint(*r.choice(ranges))) if r.random() < 0.8 else r.choice(" \n\t") for _ in range(120)) for _ in range(60)]
    return [None, "", " ", "\n\n a", "it's don't 'LL", "<|endoftext|>a <|endoftext|>", "<|endoftext", "a" * 2000, "ab" * 500 + " " * 40 + "x", "x\x00y\x7f", *mixed]


def test_bpe_equals_the_library(spark, library):
    rows = list(enumerate(odd_texts()))
    got = {r.doc_id: r for r in bpe.encode(frame(spark, rows), VOCABULARY, with_ids=True).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_in_runs_and_with_little_memory(spark, library, monkeypatch):
    rows = [(1, "".join(t or "" for t in odd_texts())), (1, "a b c " * 300), (None, "x"), (4, "short"), (5, " " * 300 + "z" * 3000)] + [(10 + k, t) for k, t in enumerate(odd_texts())]
    monkeypatch.setattr(bpe, "GROUP", 200)
    monkeypatch.setattr(bpe, "WORDS", 50)
    own = bpe.Encoder(bpe.Vocabulary.load(open(VOCABULARY, encoding="utf-8").read()))
    monkeypatch.setattr(bpe, "KEEP_BYTES", 20_000)
    for text, runs in zip([t or "" for _, t in rows], bpe.encoded_texts(own, bpe.pa.array([t or "" for _, t in rows])), strict=True):
        ids = [int(i) for _, found in runs for e in found for i in e.split(",")]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.used < 60_000 or len(text) > 2000
    assert bpe.encode(frame(spark, []), VOCABULARY).collect() == []
    got = sorted((str(x.doc_id), x.n_tokens) for x in bpe.encode(frame(spark, rows[:5]), VOCABULARY).collect())
    assert got == sorted((str(i), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows[:5])


def test_a_wrong_id_shows_in_the_decoded_text():
    own = bpe.Encoder(bpe.Vocabulary.load(open(VOCABULARY, encoding="utf-8").read()))
    v = own.vocabulary
    right, wrong = [i for i, t in enumerate(v.tokens) if t[:1] == b" " and t[1:].isalpha() and len(t) > 5 and v.whole(i)][:2]
    text = f"a{v.tokens[right].decode()} b"
    assert [own.decoded(words) for words, _ in next(bpe.encoded_texts(own, bpe.pa.array([text])))] == [text.encode()]
    assert own.decode(own.ids(text)) == text
    own.known.clear()
    own.spelled.clear()
    v.ids[v.tokens[right]] = wrong
    ((words, codes),) = next(bpe.encoded_texts(own, bpe.pa.array([text])))
    assert str(wrong) in codes and own.decoded(words) == b"a" + v.tokens[wrong] + b" b"


def test_a_worker_keeps_what_one_operator_needs_at_a_time():
    spec = open(VOCABULARY, encoding="utf-8").read()
    own = bpe.encoder(spec)
    assert bpe.encoder(spec) is own
    list(minhash._sequence_keys(iter([])))
    assert bpe.encoder(spec) is not own


def test_bpe_decodes(spark):
    rows = list(enumerate(odd_texts()))
    back = bpe.decode(bpe.encode(frame(spark, rows), VOCABULARY, with_ids=True), VOCABULARY).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in rows}


def test_trie_equals_merging():
    v = bpe.encoder(open(VOCABULARY, encoding="utf-8").read()).vocabulary
    r = random.Random(2)
    words = list({bytes(r.choice(b"abcdetionsh ") for _ in range(r.randint(1, 14))) for _ in range(400)})
    got = v.encode_words(words)
    assert all(got[w] == v.merged(w) for w in words)


def test_a_long_word_takes_memory_by_its_length(library):
    v = bpe.encoder(open(VOCABULARY, encoding="utf-8").read()).vocabulary
    word = "".join(random.Random(4).choices("abcdetionsh", k=8000)).encode()
    tracemalloc.start()
    try:
        codes, spelled = v.coded_words([word])[word]
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
    assert spelled == word and codes == ",".join(map(str, library.encode(word.decode(), add_special_tokens=False).ids))


def test_tokens_stay_two_where_merging_leaves_them():
    v = bpe.Vocabulary.load(open(VOCABULARY, encoding="utf-8").read())
    r = random.Random(5)
    whole = [i for word, i in v.ids.items() if v.whole(i)]
    repeats = [i for i in whole if len(set(v.tokens[i])) <= 2]
    pairs = [(r.choice(pool), r.choice(pool)) for pool in (whole, repeats) for _ in range(5000)]
    merged, v.merged = v.merged, None  # the test of a pair goes without encoding it
    got = [v.fits(*pair) for pair in pairs]
    assert got == [merged(v.tokens[a] + v.tokens[b]) == [a, b] for a, b in pairs] and len(set(got)) == 2


def test_ascii_texts_are_split_alike():
    own = bpe.encoder(open(VOCABULARY, encoding="utf-8").read())
    r = random.Random(6)
    texts = ["".join(chr(r.choice([r.randrange(128), 32, 32, 10, 39, 115, 116, 48, 28, 31])) for _ in range(60)) for _ in range(3000)]
    assert isinstance(own.split_ascii, re.Pattern) and [own.split_ascii.findall(t) for t in texts] == [own.split.findall(t) for t in texts]


def test_counting_carries_numbers_only():
    own = bpe.encoder(open(VOCABULARY, encoding="utf-8").read(), counts=True)
    words = [w for t in odd_texts() if t for w in own.words(t)]
    whole = bpe.Encoder(own.vocabulary)
    assert own.entries(words) == [e.count(",") + 1 for e in whole.entries(words)] and not own.spelled
    assert list(map(own.codes, words)) == whole.entries(words)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, library, rule):
    rows = [(1, "one two\n\n\n three\nfour"), (2, ""), (3, None), (4, "é\n😀 x\n"), (5, "no end")]
    got = token_counts.token_counts(frame(spark, rows), VOCABULARY, rule=rule).collect()
    for i, text in rows:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == pytest.approx(len(library.encode(text or "", add_special_tokens=False).ids))
        assert "".join((text or "")[r.start : r.end] for r in own) == (text or "")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_each_section_by_offsets(spark, library, monkeypatch, rule):
    r = random.Random(12)
    texts = ["".join(r.choice("ab  \n\né😀日x'1.") for _ in range(r.randint(0, 300))) for _ in range(60)] + [None, "<|endoftext|>\n<|endoftext|>"]
    monkeypatch.setattr(bpe, "GROUP", 100)
    monkeypatch.setattr(bpe, "WORDS", 7)
    rows = list(enumerate(texts))
    got = {}
    for x in token_counts.token_counts(frame(spark, rows), VOCABULARY, boundary=r"\n|x*", rule=rule).collect():
        got.setdefault(x.doc_id, {})[x.section] = (x.start, x.end, x.n_tokens)
    for i, text in rows:
        text = text or ""
        ends = [m.end() for m in re.finditer(r"\n|x*", text) if m.group() and m.end() < len(text)] + [len(text)]
        sections = list(zip([0, *ends[:-1]], ends))
        spans, at = [], 0
        of = [k for k, c in enumerate(text) for _ in range(len(c.encode()))]
        own = bpe.encoder(open(VOCABULARY, encoding="utf-8").read()).vocabulary
        for t in library.encode(text, add_special_tokens=False).ids:
            size = len(own.tokens[t])
            spans.append((of[at], of[at + size - 1] + 1))
            at += size

        def share(a, b, x, y):
            if rule == "split":
                return max(0, min(b, y) - max(a, x)) / (y - x)
            return float(a <= x < b) if rule == "first" else float(a < y <= b)

        assert [got[i][k][:2] for k in range(len(sections))] == sections
        for k, (a, b) in enumerate(sections):
            assert got[i][k][2] == pytest.approx(sum(share(a, b, *s) for s in spans)), (text, k)


def test_token_that_crosses(spark):
    # "\n\n" is one token across the boundary of the two sections
    docs = frame(spark, [(1, "a\n\n")])
    counts = {rule: [r.n_tokens for r in token_counts.token_counts(docs, VOCABULARY, rule=rule).orderBy("section").collect()] for rule in token_counts.RULES}
    assert counts["first"][0] > counts["last"][0] and sum(counts["first"]) == sum(counts["last"])


def brute_contaminated(docs, items):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[k : k + 13]) for k in range(max(1, len(w) - 12))] if w else []
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(item)} if item is not None else set()
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontaminate(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 13, 14, 30])))) for k in range(12)] + [(99, None), (98, "!!"), (None, "null id item"), (10, "Élan über alles")]
    docs = []
    for k in range(60):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))] + [r.choice(items)[1] or "" for _ in range(r.randint(0, 2))]
        docs.append((k, "; ".join(parts).upper() if k % 3 else ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "élan ÜBER alles"), (103, "Élan über alles"), (104, items[5][1]), (105, "a null id item")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, token string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert got == brute_contaminated(docs, items)
    empty = decontaminate.decontaminate(frame(spark, docs), bench.limit(0)).collect()
    assert len(empty) == len(docs) and not any(x.contaminated for x in empty)
    assert decontaminate.decontaminate(frame(spark, []), bench).collect() == []


def base_by_pattern(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")) or k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(4)
    texts = ["a@b@c.d.e", "x.a@b.co_m@e.fg", "1.2.3.4.5.6.7.8", "0001.255.256.1 0255.1.1.1", "+1 (984) 555-5227", "4111 1111 1111 1111", "é a@b.c 日本 10.0.0.1"]
    texts += ["".join(r.choice("ab1230+.@ -()_%4") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == base_by_pattern(text), text


def test_pii_keeps_base_and_adds(spark):
    secret = "3e3a2fc1175ddce81e12b0dbe88ca7be964edc16"
    rows = [(k, f'mail a{k}@b.com and token = "{secret[k % 7:]}{k}" end') for k in range(40)] + [(100, None), (101, ""), (102, "version 1234567890123456 page")]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert got[3].n_email == 1 and got[3].spans.startswith("email:5:13") and "secret:" in got[3].spans
    assert got[3].base_sha256 == hashlib.sha256(b"email:5:13").hexdigest()
    assert got[100].spans == "" and got[102].spans == "" and got[101].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(frame(spark, [])).collect() == []


def test_pii_of_each_kind_and_length(spark):
    r = random.Random(13)
    hexes = "0123456789abcdef"

    def card():
        head = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(head + d for d in "0123456789" if pii.luhn(head + d))

    make = {
        "email": lambda: "".join(r.choice("abcxyz.") for _ in range(r.choice([5, 90]))).strip(".") + "q@" + "host" * r.choice([1, 30]) + ".com",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: "+1 (%03d) 555-%04d" % (r.randint(200, 999), r.randint(0, 9999)),
        "secret": lambda: "".join(r.choice(hexes) for _ in range(r.choice([40, 64, 144, 600]))) + "7f",
    }
    rows, planted = [], {}
    for k in range(400):
        kind = list(make)[k % 5]
        value = make[kind]()
        text = f"{'word ' * r.randint(0, 9)}{'key: ' if kind == 'secret' else ''}{value} and so on"
        planted[k] = (kind, text.index(value), text.index(value) + len(value))
        rows.append((k, text))
    rows += [(k, "plain prose of words alone, nothing else " * 3) for k in range(400, 500)] + [(7000, "x"), (7000, "a@b.cd"), (None, "a@b.cd")]
    got = {}
    for x in pii.find_personal_data(frame(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append(x)
    caught = {kind: [] for kind in make}
    for k, (kind, a, b) in planted.items():
        one = got[k][0]
        base = base_by_pattern(rows[k][1])
        assert one.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[n]}:{x}:{y}" for x, n, y in base).encode()).hexdigest()
        assert [one.n_email, one.n_ip, one.n_card, one.n_phone] == [sum(n == j for _, n, _ in base) for j in range(4)]
        assert {f"{pii.KINDS[n]}:{x}:{y}" for x, n, y in base} <= set(one.spans.split(",")) | {""}
        caught[kind].append(f"{kind}:{a}:{b}" in one.spans.split(","))
    assert {kind: sum(v) / len(v) for kind, v in caught.items()} == {kind: 1.0 for kind in make}
    assert all(got[k][0].spans == "" for k in range(400, 500)) and sorted(x.n_email for x in got[7000]) == [0, 1] and got[None][0].n_email == 1


def test_pii_sweep_equals_all_pairs():
    r = random.Random(14)
    for _ in range(300):
        base = [(a, a + r.randint(1, 9)) for a in (r.randint(0, 80) for _ in range(r.randint(0, 6)))]
        taken, added = pii._Taken(base), []
        for _ in range(20):
            a = r.randint(0, 90)
            b, around = a + r.randint(1, 9), r.random() < 0.5
            free = not any(a < y and x < b for x, y in added)
            free &= not any(a < y and x < b for x, y in base if not (around and a <= x and y <= b))
            assert taken.add(a, b, around) == free
            added += [(a, b)] * free


def test_em_tells_reliable_labelers():
    post = pii.em({(0, (1, 1, 1, -1, 1, 1)): 500, (0, (0, 0, -1, 0, 0, 0)): 500, (0, (1, -1, -1, -1, 1, 1)): 100})
    assert post[0, (1, 1, 1, -1, 1, 1)] > 0.95 > 0.05 > post[0, (0, 0, -1, 0, 0, 0)]


def test_licenses(spark):
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "nothing"), (4, None), (5, "x " * 5000 + "All rights reserved. " + "y " * 5000), (6, "a licence to kill time, nothing else to see")]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (got[1].license, got[1].start, got[1].end, got[1].exact) == ("MIT", 6, 37, True)
    assert got[2].license == "Apache-2.0" and got[2].confirmed and got[5].license == "all-rights-reserved"
    assert 3 not in got and 4 not in got
    assert 6 in got and not got[6].exact and not got[6].confirmed if "licen" in rows[5][1] else 6 not in got
    assert licenses.scan_licenses(frame(spark, [])).collect() == []


def test_many_notices_of_one_text_take_time_in_proportion():
    own, took = licenses.Matcher(licenses.TEMPLATES), []
    for n in (3_000, 24_000):
        text = "".join(f"line {k} SPDX-License-Identifier: MIT\nAll rights reserved. Part {k}\n" for k in range(n))
        began = time.process_time()
        assert len(own.scan(text)) == 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 1  # eight times the text


def test_licenses_wrapped_and_several(spark):
    def wrapped(name, width=40, mark="# "):
        return "\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[name], width))

    long_names = ["MIT-grant", "Apache-2.0-header", "GPL-2.0", "BSD"]
    rows = [(k, f"code\n{wrapped(n)}\nmore code") for k, n in enumerate(long_names)]
    rows += [(10, licenses.TEMPLATES["BSD"]), (11, "Released under the MIT License. Some words between. All rights reserved."), (12, "Some rights reserved.\nAll in all, prose."), (13, "\n".join([wrapped("BSD"), "x", wrapped("GPL-2.0"), "Released under the\nMIT License."]))]
    rows += [(14, wrapped("BSD").replace("Redistribution", "Copying")), (15, "Released under the MIT License.\nprose\nReleased under the MIT License.")]
    got = {}
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        if r.confirmed:
            got.setdefault(r.doc_id, []).append(r.license)
    for k, name in enumerate(long_names):
        assert name in got[k], name
    assert got[10] == ["BSD"] and sorted(got[11]) == ["MIT", "all-rights-reserved"] and 12 not in got
    assert sorted(got[13]) == ["BSD", "GPL-2.0", "MIT"] and got[14] == ["BSD"] and got[15] == ["MIT", "MIT"]
    one = next(r for r in licenses.scan_licenses(frame(spark, rows[:1])).collect() if r.license == "MIT-grant")
    assert (one.start, one.end, one.n_lacking) == (5, len(rows[0][1]) - len("\nmore code"), 0)


def plain_common(want, here):
    row = [0] * (len(want) + 1)
    for word in here:
        old = 0
        for k, w in enumerate(want, 1):
            old, row[k] = row[k], old + 1 if w == word else max(row[k], row[k - 1])
    return row[-1]


def test_wordings_by_bits_equal_the_plain_table():
    r = random.Random(15)
    for _ in range(300):
        want, here = ([r.choice("abcde") for _ in range(r.randint(1, 90))] for _ in range(2))
        wording = licenses.Wording(" ".join(want))
        assert wording.common(here)[0] == wording.common(here, back=True)[0] == plain_common(want, here)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "    "])
def test_every_template_wrapped_indented_and_commented(mark):
    own = licenses.Matcher(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        body = "\n".join(mark + x for x in textwrap.wrap(text, 50, break_long_words=False, break_on_hyphens=False))
        rows = [x for x in own.scan(f"int main;\n{body}\nreturn 0;") if x[-1]]
        assert [(x[2], x[-2]) for x in rows] == [(name, True)], name
        assert rows[0][0] == 10 and rows[0][1] == 10 + len(body)


def test_confirmed_notices_equal_a_search_over_all_templates():
    """Every template whose words stand in order, but for a tenth, in a stretch that is not too long is found where they stand; no other is."""
    r = random.Random(16)
    names = ["MIT", "MIT-grant", "Apache-2.0-header", "GPL-2.0", "BSD", "MPL-2.0", "CC-BY-4.0", "all-rights-reserved"]
    own = licenses.Matcher({n: licenses.TEMPLATES[n] for n in names})
    filler = "the of and software license copyright work use in terms under rights all modify public".split()
    for _ in range(150):
        words = []
        for _ in range(r.randint(0, 3)):
            words += [r.choice(filler) for _ in range(r.randint(0, 25))]
            name = r.choice(names)
            part = own.wordings[name].words
            drop = r.choice([0, 0, 0.05, 0.3])
            words += [w for w in part if r.random() >= drop]
        words += [r.choice(filler) for _ in range(r.randint(0, 25))]
        low = " ".join(words)
        spans = [m.span() for m in licenses._WORD.finditer(low)]
        assert [low[a:b] for a, b in spans] == words
        rows = own.notices(low, words, spans)
        for a, b, name, _, lacking, more in rows:
            part = own.wordings[name].words
            assert plain_common(part, words[a:b]) == len(part) - lacking >= own.wordings[name].least and b - a - (len(part) - lacking) == more and b - a <= own.wordings[name].most
        free = [k for k in range(len(words)) if not any(a <= k < b for a, b, *_ in rows)]
        for name, wording in own.wordings.items():  # nothing confirmable is left in the words of no notice
            runs, at = [], 0
            for k in range(1, len(free) + 1):
                if k == len(free) or free[k] != free[k - 1] + 1:
                    runs.append(free[at:k])
                    at = k
            for run in runs:
                for k in range(len(run)):
                    stretch = [words[x] for x in run[k : k + wording.most]]
                    assert plain_common(wording.words, stretch) < wording.least or name in {x[2] for x in rows}, (name, stretch)


PAGES = "page_id long, url string, html string, sha string, keep long"


def test_warc_round_trip(spark):
    big = "é" * 700_000
    rows = [(1, "http://a/ b", "x" * 1200), (2, None, "x" * 1200), (3, "http://c", "x" * 999), (4, "http://d", "x" * 999), (5, "http://e", None), (6, "http://f", big), (7, "http://g", big + "z"), (8, "http://h", "a\r\n\r\nWARC/1.1\r\n\r\n" * 90), (None, "http://n", "x" * 1200)]
    pages = spark.createDataFrame([(*r, "s", 0) for r in rows], PAGES)
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {1: 2, None: 2}
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


@pytest.mark.parametrize("few", [500_000, 0])
def test_warc_of_one_payload_on_most_pages(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    monkeypatch.setattr(warc, "ROWS_PER_SALT", 5)
    rows = [(k, f"http://h/{k}", "hot" * 500 if k % 3 else "cold" + str(k % 5) * 1000 if k % 2 else "small") for k in range(120)] + [(119, "http://again", "hot" * 500)]
    pages = spark.createDataFrame([(*x, "s", 0) for x in rows], PAGES)
    got = sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to or -1) for x in warc.round_trip(spark, pages).collect())
    want = []
    for page, _, html in rows:
        raw = html.encode()
        keep = max(p for p, _, h in rows if h == html)
        again = len(raw) >= 1000 and page != keep
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keep if again else -1))
    assert got == sorted(want)


def test_archive_whose_head_has_no_end():
    import gzip
    import io

    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\n" + b"x" * (warc.HEAD * 3)))))


def test_warc_chunks(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 1_300_000, "s", 0)], PAGES)
    from tessitura.llm.common import scratch

    chunks = warc.read_archives(warc.write_archives(pages, scratch(spark, "w"))).orderBy("chunk_no").collect()
    assert [c.chunk_no for c in chunks] == [0, 1, 2] and [c.last for c in chunks] == [False, False, True]
    raw = b"".join(bytes(c.data) for c in chunks)
    assert raw.decode() == "é" * 1_300_000 and chunks[1].sha1 == hashlib.sha1(raw[: 2 << 20]).hexdigest()


def toxic_rows(n):
    r = random.Random(6)
    words = ["".join(r.choice("abdeghinorstw") for _ in range(r.randint(2, 8))) for _ in range(300)]
    bad = ["idiot", "moron", "scum", "clown"]
    rows = []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = int(k % 4 == 0)
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(900)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in rows], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.95
    assert got[5000].score == got[5001].score and 0 <= got[5000].score <= 1
    kept = {r.doc_id for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    assert any(w in b"".join(model.toxic) for w in (b"idiot", b"moron", b"scum", b"clown"))
    plain = " ".join(t for _, t, y in rows if not y).encode()
    assert all(any(d[k : k + 8] in plain for k in range(len(d) - 200, len(d) - 8)) for d in model.ordinary)
    assert all(d not in model.ground for d in model.ordinary) and len(model.ground) > 1000
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_of_odd_tables(spark):
    rows = toxic_rows(300)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(7, "twice"), (None, "no id"), (None, rows[0][1]), (8000, "idiot " * 40_000)])
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 304 and all(0 <= x.score <= 1 for x in got) and sum(x.doc_id == 7 for x in got) == 2
    assert not any(x.held_out for x in got if x.doc_id is None)
    assert toxicity.score(frame(spark, []), model).collect() == [] and toxicity.reject(docs.limit(0), model).collect() == []
    assert toxicity.train(frame(spark, []), labels).weights == toxicity.train(docs, labels.where("doc_id < 0")).weights


def test_toxicity_rate_is_that_of_all_labels(spark, monkeypatch):
    # texts that say nothing about their label: the score is the rate of all labels, whatever the caps of the sample
    r = random.Random(8)
    words = ["".join(r.choice("abdeghinorstw") for _ in range(r.randint(2, 8))) for _ in range(50)]
    docs = frame(spark, [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(1000)])
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(1000)] + [(k, 1) for k in range(5000, 5900)], "doc_id long, toxic int")
    scores = []
    for caps in ((1000, 1000), (60, 110)):
        monkeypatch.setattr(toxicity, "TOXIC_SAMPLE", caps[0])
        monkeypatch.setattr(toxicity, "ORDINARY_SAMPLE", caps[1])
        got = [x.score for x in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
        scores.append(sum(got) / len(got))
    assert scores == pytest.approx([0.125, 0.125], abs=0.03)

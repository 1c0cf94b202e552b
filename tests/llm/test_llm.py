"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from barloom.llm import _text as text_kernels
from barloom.llm import bpe, decontaminate, elkan, id_coder, licenses, maxent, near_dedup, pseudonyms, quality, queries, sharding, substring_dedup, token_files, vector_codes, vector_search
from tests.oracle import rows_of, rows_of_sql

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, pid int, id long"
RANKS = path("byte_bpe_50k.tiktoken")


def table(spark, texts, ids=None):
    """Documents with further columns whose names clash with those of the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 7, -1) for i, t in zip(ids, texts)], SCHEMA)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edge_texts(seed=3):
    rng = random.Random(seed)
    a, b, shared = sentence(rng, 60), sentence(rng, 80), sentence(rng, 30)
    near = a.split()
    near[10] = "changed"
    return [a, None, "", "  \n\t ", "one", "one two", "One  TWO", a, " ".join(near), b + " " + shared, shared + " " + sentence(rng, 50), sentence(rng, 3000), "x" * 50_000, b.upper(), shared, shared + " " + shared]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(queries.ORACLE_SQL[name], sf)


def words(text):
    return (text or "").encode().split()


def test_remove_repeats(spark):
    texts = edge_texts()
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, texts)).collect()}
    seen = {}
    for i, x in enumerate(texts):
        w = words(x)
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), i)
    for i, x in enumerate(texts):
        w = words(x)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(a for a, g in zip(w, gone) if not g).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), kept)
        assert sum(s.end - s.start for s in got[i].repeats) == sum(gone)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0
    odd = substring_dedup.remove_repeats(table(spark, [texts[0]] * 4, [5, 5, None, 6])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in odd) == [(0, 0), (5, 0), (5, 0), (6, 60)]


def shingles(text, size):
    w = (text or "").encode().translate(LOW).split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rng = random.Random(4)
    texts = edge_texts()
    hub = sentence(rng, 120).split()
    for _ in range(30):  # a group whose members differ by a few words from the hub
        copy = list(hub)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    sets = [shingles(x, size) for x in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts), size, percent).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_duplicates_of_odd_rows(spark):
    rows = near_dedup.near_duplicates(table(spark, ["a b c d e f", "a b c d e f", "q r s t u v", None], [3, None, 3, 9]), 5, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (3, 3, True), (3, 3, True), (9, 9, True)]
    assert near_dedup.near_duplicates(table(spark, []), 5, 80).count() == 0


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = edge_texts() + ["".join(rng.choice("abcdeh thеé!?'s \n\t12漢字🙂--==__") for _ in range(rng.randrange(80))) for _ in range(200)] + ["<|endoftext|> it's", "a" * 3000]
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(table(spark, texts), RANKS, PATTERN), RANKS, PATTERN).collect()}
    for i, x in enumerate(texts):
        ids = library.encode_ordinary(x or "")
        assert np.frombuffer(bytes(rows[i].token_ids), "<u4").tolist() == ids and rows[i].n_tokens == len(ids)
        assert bytes(rows[i].decoded) == (x or "").encode()
    v = bpe.vocabulary(RANKS, PATTERN)
    for _ in range(300):
        w = "".join(rng.choice("abcdehst") for _ in range(rng.randrange(1, 300))).encode()
        p, i = bpe.Prefixes(v, w), rng.randrange(len(w))
        j, new = min(len(w), i + rng.randrange(6)), rng.choice([b"", b"x", b"the"])
        p.replace(i, j, new)
        assert p.last == bpe.Prefixes(v, w[:i] + new + w[j:]).last
        d = bpe.Document(v, w[:i].decode())
        d.append(w[i:].decode())
        assert d.ids() == v.encode(w.decode())
    assert bpe.encode(table(spark, []), RANKS, PATTERN).count() == 0


def slow_top_k(vectors, k, every):
    """(query, rank) to (id, score) for {id: whole numbers}, and lists of ids where rows share one."""
    expected = {}
    for q in (i for i in vectors if i % every == 0):
        scores = ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(vectors[q], v)))), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        expected |= {(q, n + 1): (i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])}
    return expected


def found_top_k(rows):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows.collect()}


def test_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = [rng.standard_normal(16).tolist() for _ in range(300)] + [None, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16, [0.0] * 16, [1.0] * 3, [], [2.0] * 3]
    vectors[7] = vectors[5]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(vectors)] + [(None, vectors[0], 1, 2, "x")], "vec_id long, embedding array<float>, rank int, score long, tag string")
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for blocks in (1000, 3):
        assert found_top_k(vector_search.top_k(df, df.where("vec_id % 50 = 0"), 10, query_rows=blocks)) == slow_top_k(whole, 10, 50)
    assert vector_search.top_k(df.limit(0), df, 10).count() == 0 and vector_search.top_k(df, df.limit(0), 10).count() == 0


def test_large_finite_vectors_take_part(spark):
    vectors = {0: [1e14, 0.0], 1: [3.0, 4.0], 2: [2.0, 1e200], 3: [-1e14, 5.0], 4: [1e14, 1.0], 5: [0.5, -0.5], 6: [1e300, -1e300], 100: [0.25, 1e13], 200: [1e308, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [int(math.floor(1024 * x)) for x in v] for i, v in vectors.items() if i != 200}
    for k in (1, 3, 10):
        assert found_top_k(vector_search.top_k(df, df.where("vec_id % 100 = 0"), k)) == slow_top_k(whole, k, 100)


@pytest.mark.parametrize("copies", [50, 300, 2700])
def test_vectors_with_many_equal_ones(spark, copies):
    rng = np.random.default_rng(copies)
    exact = rng.standard_normal((3000, 8)).astype(np.float32)
    exact[rng.permutation(3000)[:copies]] = exact[0]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(3000), exact)], "vec_id long, embedding array<float>").repartition(5)
    whole = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in df.collect()}
    assert found_top_k(vector_search.top_k(df, df.where("vec_id % 500 = 0"), 10)) == slow_top_k(whole, 10, 500)


def test_rows_that_share_a_vector_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    rows = vector_search.top_k(df, df.where("vec_id = 0"), 3, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, 3), (1, 2), (1, 2)]


def test_bounds_hold():
    rng = np.random.default_rng(14)
    for scale in (1.0, 1e6, 1e140):
        exact, queries = np.floor(scale * rng.standard_normal((200, 24))), np.floor(scale * rng.standard_normal((20, 24)))
        low, high = vector_search.Cells.of(exact).bounds(queries)
        for i, q in enumerate(queries):
            scores = vector_search.dots(exact, q)
            assert all(a <= s <= b for a, s, b in zip(low[i], scores, high[i]))


def test_contamination(spark):
    rng = random.Random(7)
    item = "If Alice buys 3 apples for 12 dollars and then Bob buys 5 pears for 20 dollars how much money did they spend on fruit today"
    other = item.replace("Alice", "Maria").replace("Bob", "Peter").replace(" 3 ", " 7 ").replace("12", "45").replace(" 5 ", " 9 ").replace("20", "31")
    short = "Who wrote this small book"
    fill = sentence(rng, 200)
    texts = [f"{fill} {item} {fill}", f"{fill}\n{other}, {fill}", fill, None, "", f"x {short.upper()}! y", item.lower(), "Tom had 4 apples for 2 dollars and then went home", short + " indeed"]
    docs, items = table(spark, texts), spark.createDataFrame([(1, item), (2, short), (3, None), (None, item), (4, "")], "item_id long, text string")
    for limit in (decontaminate.WINDOW_LIMIT, 0):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, items, limit=limit).collect()) == [(0, 1), (1, 1), (5, 2), (6, 1), (8, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 3, 4, 7]
    assert decontaminate.find(docs, items.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), items).count() == 0


def contaminated(spark, texts, items, fill):
    docs = table(spark, [f"{fill} {x}. {fill}" for x in texts])
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = [{(r.doc_id, r.item_id): (r.covered, r.words) for r in decontaminate.find(docs, items, limit=limit).collect()} for limit in (decontaminate.WINDOW_LIMIT, 0)]
    assert found[0] == found[1]
    return found[0]


def test_contamination_by_edited_copies(spark):
    item = [f"q{i}" for i in range(40)]
    slots = "a shop in New York sold 1,500 pears at 3.5 dollars each and sent them over 5km of road to the small harbour where Ann Lee waited for her ship"
    other = slots.replace("New York", "Paris").replace("1,500", "900").replace("3.5", "7").replace("5km", "8 miles").replace("Ann Lee", "Bo")
    texts = [
        " ".join(item[:20] + ["new"] + item[20:]), " ".join(item[:20] + item[21:]), other, slots.replace("1,500", "12,000.5").replace("5km", "9kg"),
        slots.replace("1,500", "1 700").replace("New York", "San, Jose"), " ".join(item[:9] + item[20:29]), "nothing of it",
    ]
    got = contaminated(spark, texts, [" ".join(item), slots], sentence(random.Random(17), 60))
    assert sorted(got) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)] and got[0, 0] == (40, 40) and got[1, 0] == (39, 40)


def test_contamination_by_passages(spark):
    long = [f"r{i}" for i in range(59)]
    numbers = "count 1 2 3 4 5 6 7 8 9 10 11 and then say what number it is that comes after the last of them here"
    texts = [" ".join(long[12:47]), " ".join(long[30:]), " ".join(long[:12]), " ".join(long[:9] + long[20:29]), "1 2 3 4 5 6 7 8 9 10 11 12", "nothing of it"]
    got = contaminated(spark, texts, [" ".join(long), numbers], sentence(random.Random(18), 60))
    assert got == {(0, 0): (35, 59), (1, 0): (29, 59), (2, 0): (12, 59)}


def test_contamination_by_other_parameters(spark):
    """Re-parameterised copies of one item: spelled numbers, separators, other units and names; not one whose values all fall together."""
    item = "Alice has 12 apples and buys 3 more for 20 dollars while Bob sells 1,200 pears so how many apples does Alice have in the end of it"
    good = [
        item.replace("Alice", "Maria").replace("12", "45"), item.replace("1,200", "90").replace("Bob", "Van Dyke"), item.replace(" 3 ", " three ").replace("12", "seven"),
        item.replace("dollars", "rupees").replace("20", "31"), item.replace("Alice", "Mary Ann").replace(" 3 ", " 8 "), item.lower().replace("12", "13"),
    ]
    flat = item.replace("Alice", "Ann").replace("Bob", "Ann").replace("12", "7").replace(" 3 ", " 7 ").replace("20", "7").replace("1,200", "7")
    got = contaminated(spark, [*good, flat, "nothing of it"], [item], sentence(random.Random(19), 60))
    assert sorted(d for d, _ in got) == [0, 1, 2, 3, 4, 5]


def test_contamination_of_odd_tables(spark):
    item = sentence(random.Random(20), 30)
    long = sentence(random.Random(21), 60_000, 5000)
    rows = [(i, x, 1) for i, x in enumerate([item, item, f"{long} {item} {long}", long, None, ""])] + [(1, item, 1), (None, item, 1)]
    docs = spark.createDataFrame([(*r, "y", 3, 4) for r in rows], "doc_id long, text string, __bad int, item_id string, hash long, line int")
    items = spark.createDataFrame([(1, item, 9)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()) == [(0, 1), (1, 1), (2, 1)]
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 3, 4, 5]


def slow_contained(texts, items):
    """Pairs that share ten words in a row with four that are no numbers, by plain search."""
    cut = lambda x: ["".join(c for c in w) for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()]
    out = set()
    for j, x in enumerate(items):
        w = cut(x)
        runs = {tuple(w[k : k + 10]) for k in range(len(w) - 9) if sum(not v.isdigit() for v in w[k : k + 10]) >= 4}
        for i, y in enumerate(texts):
            v = cut(y)
            if any(tuple(v[k : k + 10]) in runs for k in range(len(v) - 9)):
                out.add((i, j))
    return out


def test_contamination_holds_every_shared_passage(spark):
    rng = random.Random(22)
    items = [sentence(rng, rng.randrange(12, 40), 3000) for _ in range(30)]
    texts = []
    for i in range(80):
        words_ = sentence(rng, 120, 3000).split()
        if i % 2:
            part = rng.choice(items).split()
            k = rng.randrange(len(part) - 9)
            words_[50:50] = part[k : k + rng.randrange(8, 14)]
        texts.append(" ".join(words_))
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(table(spark, texts), rows).collect()}
    assert got >= slow_contained(texts, items) and len(got) <= len(slow_contained(texts, items)) + 2


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["pay 4465758382889437 or 4465-7583-8288-9437", "no 4465758382889438", "+1 (663) 555-6869", "10.1.2.3 and 999.1.1.1", "born 1984-02-29, not 1983-02-29", "DE89 3704 0044 0532 0130 00", "123-45-6789 000-12-3456", "mail a.bc@mail.example.com.", 'k = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, "", "plain", "z" * 30_000 + " 4465758382889437"]
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(table(spark, texts), "key").collect()}
    card = rows[0].text.split()
    assert luhn(card[1]) and card[3].replace("-", "") == card[1] != "4465758382889437" and rows[12].text.endswith(card[1])
    assert [rows[i].text for i in (1, 9, 10, 11)] == [texts[1], None, "", "plain"]
    assert rows[2].text.startswith("+1 (") and len(rows[2].text) == len(texts[2]) and rows[2].text != texts[2]
    assert rows[3].text.endswith("999.1.1.1") and all(0 <= int(x) < 256 for x in rows[3].text.split()[0].split("."))
    assert "1984-02-29" not in rows[4].text and rows[4].text.endswith("1983-02-29")
    iban = rows[5].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE" and rows[5].text != texts[5]
    assert rows[6].text.endswith("000-12-3456") and "123-45-6789" not in rows[6].text
    assert rows[7].text.endswith("@mail.example.com.") and "a.bc@" not in rows[7].text
    assert [rows[0].n_card, rows[2].n_phone, rows[3].n_ip, rows[4].n_date, rows[5].n_iban, rows[6].n_ssn, rows[7].n_email, rows[8].n_token, rows[9].n_card] == [2, 1, 1, 1, 1, 1, 1, 1, 0]
    assert pseudonyms.pseudonymise(table(spark, []), "key").count() == 0


def test_pseudonyms_beside_other_groups(spark):
    card, iban, phone = "4465758382889437", "AT611904300234573201", "+1 (663) 555-6869"
    cards = [f"{card} 100 euro", f"order 100 {card}", f"{card}-12 x", f"{card} {card}", f"in 2024 {card} 1"]
    cards += [f"{card} {i}" for i in range(100, 120)]  # some of these pass Luhn as a whole
    ibans = [f"{iban} BIC", f"{iban} BANK", f"to {iban} KONTOVERBINDUNGSNUMMER", f"AB12 {iban} X"]
    phones = [f"{phone} 2024", f"{phone} 1234 5678 9012"]
    texts = [card, iban, phone, "4111 1111 1111 1111 12/25", "4111 1111 1111 1111", "+49 (30) 1234 5678 9012 3456"] + cards + ibans + phones
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(table(spark, texts), "key").collect()}
    new = {x: rows[i].text for i, x in enumerate((card, iban, phone))}
    assert all(a != b for a, b in new.items()) and rows[3].text == rows[4].text + " 12/25" and rows[3].text != texts[3]
    for i in range(6, len(texts)):
        assert rows[i].text == next(texts[i].replace(a, b) for a, b in new.items() if a in texts[i]), texts[i]
    assert rows[5].text != texts[5] and rows[5].text.startswith("+49 (")
    assert [rows[i].n_card for i in range(3, 11)] == [1, 1, 0, 1, 1, 1, 2, 1] and all(rows[i].n_iban for i in range(31, 35))


def test_pseudonyms_of_further_formats(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    texts = ["A.B@x.example.com", "a.b@x.example.com", "Dec 25, 1990 and December 25, 1990", "2001:db8:85a3:0:0:8a2e:370:7334 fe80::1ff:fe23", key, "sk-" + "a1B2" * 6, "version 1.2.3.4 and v1.2.3.4", "1.2.3.4", "Feb 30, 1990", "12:30:45"]
    rows = [r.text for r in pseudonyms.pseudonymise(table(spark, texts), "key").orderBy("doc_id").collect()]
    assert rows[0].lower() == rows[1].lower() != texts[1] and rows[0][0].isupper() and rows[0][2].isupper() and rows[1] == rows[1].lower()
    short, long = rows[2].split(" and ")
    assert short != "Dec 25, 1990" and long.startswith(short[:3]) and short.split(" ", 1)[1] == long.split(" ", 1)[1]
    assert rows[3] != texts[3] and [len(x) for x in rows[3].split(":")] == [len(x) for x in texts[3].split(":")] and rows[3].count("::") == 1
    assert rows[4] != key and rows[4].startswith("AKIA") and len(rows[4]) == 20 and rows[4].isalnum() and rows[4].upper() == rows[4]
    assert rows[5] != texts[5] and rows[5].startswith("sk-") and len(rows[5]) == len(texts[5])
    assert rows[6] == texts[6] and rows[7] != texts[7] and rows[8:] == texts[8:]


def test_pseudonyms_of_odd_tables(spark):
    docs = table(spark, ["call +1 (663) 555-6869", "call +1 (663) 555-6869", None]).withColumnRenamed("tie", "__found").withColumnRenamed("lang", "found").withColumnRenamed("id", "got")
    out = pseudonyms.pseudonymise(docs, "key", counts=False)
    assert out.columns == docs.columns
    rows = out.orderBy("doc_id").collect()
    assert rows[0].text == rows[1].text != "call +1 (663) 555-6869" and rows[2].text is None and rows[0]["__found"] == "x" and rows[0].found == "en"


def slow_permuted(key, kind, digits):
    """The permutation of a digit string, round by round."""
    n = len(digits)
    u = n // 2
    l, r, a, b = int(digits[:u] or 0), int(digits[u:]), 10**u, 10 ** (n - u)
    number = lambda i, x: int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(pseudonyms.ROUNDS):
        l, r = ((l + number(i, r)) % a, r) if i % 2 == 0 else (l, (r + number(i, l)) % b)
    return f"{l:0{u}d}" * bool(u) + f"{r:0{n - u}d}"


def test_pseudonyms_by_brute_force(spark):
    """Cards, plain phones and social security numbers of random texts, found and permuted by hand."""
    rng = random.Random(23)
    texts, expected = [], []
    for i in range(120):
        body = str(rng.randrange(3, 6)) + "".join(str(rng.randrange(10)) for _ in range(14))
        card = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        wrong = body + str((int(card[-1]) + 1) % 10)
        phone = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        fill = sentence(rng, 5)
        new = card[0] + slow_permuted("key", "card", card[1:-1])
        new += next(str(c) for c in range(10) if luhn(new + str(c)))
        digits = slow_permuted("key", "phone", phone.replace("-", ""))
        texts.append(f"{fill}: {card}, {fill}: {wrong}; {phone}")
        expected.append(f"{fill}: {new}, {fill}: {wrong}; {digits[:3]}-{digits[3:6]}-{digits[6:]}")
    assert [r.text for r in pseudonyms.pseudonymise(table(spark, texts), "key").orderBy("doc_id").collect()] == expected


def test_pseudonyms_are_permutations(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    made = n.select(pseudonyms.permuted_digits("k", "t", F.col("d")).alias("x"), pseudonyms.permuted_digits("other", "t", F.col("d")).alias("y")).collect()
    assert len({r.x for r in made}) == 1000 == len({r.y for r in made}) and [r.x for r in made] != [r.y for r in made]
    days = spark.range(2000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"), F.col("id").alias("doc_id"))
    assert pseudonyms.pseudonymise(days, "k").select("text").distinct().count() == 2000


def test_licenses(spark):
    long = licenses.TEMPLATES["MIT-grant"]
    fill = " ".join(f"w{i}" for i in range(300))
    texts = [f"{fill} Released under the MIT License. {fill}", f"{fill} {long.upper()} {fill}", long.replace("charge", "fee", 1), " ".join(long.split()[:15]), "license", None, "", fill, "Released under the MIT License"]
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {(0, "MIT"), (1, "MIT-grant"), (2, "MIT-grant"), (8, "MIT")}
    assert licenses.scan(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(table(spark, texts), {"short": "two words"})


def test_licenses_tell_variants_apart(spark):
    t = licenses.TEMPLATES
    fill = " ".join(f"w{i}" for i in range(40))
    two = f"{fill} {t['BSD-grant']}: {fill} {t['BSD-disclaimer']}"
    texts = [two, f"{two} {t['BSD-3-endorsement']}", t["GPL-2.0-header"], t["GPL-header"], f"{fill * 300} {t['MIT-notice']} {fill} {t['MIT-notice']}"]
    best = {}
    for r in licenses.scan(table(spark, texts + texts[:1], [0, 1, 2, 3, 4, 0])).collect():
        best.setdefault(r.doc_id, {})[r.license] = (r.containment, r.word)
    assert set(best[0]) == {"BSD-grant", "BSD-disclaimer"} and set(best[1]) == {"BSD-grant", "BSD-disclaimer", "BSD-3-endorsement"}
    assert best[2]["GPL-2.0-header"][0] == 1.0 > best[2].get("GPL-header", (0, 0))[0] and best[3]["GPL-header"][0] == 1.0 > best[3].get("GPL-2.0-header", (0, 0))[0]
    assert best[4]["MIT-notice"][0] == 1.0 and best[4]["MIT-notice"][1] <= len(licenses.words_of(fill * 300))


def quality_rows(spark, n=300):
    rng = random.Random(8)
    texts, marks = [], []
    for i in range(n):
        text = sentence(rng, rng.randrange(20, 80))
        bad = i % 4 == 0
        texts.append(" ".join(f"{w.upper()}!!" for w in text.split()) if bad else text)
        marks.append((i, int(not bad)))
    return table(spark, texts + [None, "", "q " * 40_000]), spark.createDataFrame(marks + [(None, 1), (5, None)], "doc_id long, quality int")


def test_quality(spark):
    docs, labels = quality_rows(spark)
    model = quality.fit(docs, labels.where(~quality.held_out()), ["n_chars"])
    rows = quality.score(docs, model, ["n_chars"]).collect()
    assert len(rows) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    aside = [r for r in rows if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in aside) >= 0.95 * len(aside)
    assert quality.score(docs.limit(0), model, ["n_chars"]).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_quality_of_odd_tables(spark):
    docs, labels = quality_rows(spark, 80)
    model = quality.fit(docs, labels.union(labels), ["n_chars"])
    again = quality.fit(docs.repartition(7), labels.union(labels).repartition(3), ["n_chars"])
    assert np.array_equal(model.weights, again.weights)
    named = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "predicted").withColumnRenamed("tie", "k0")
    twice = named.union(named.where("doc_id < 5"))
    kept = quality.accepted(twice, model, ["n_chars"])
    good = {(r.doc_id, r.predicted) for r in quality.score(docs, model, ["n_chars"]).collect()}
    assert kept.columns == named.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, p in good if p for _ in range(1 + (i < 5)))
    tied = labels.union(labels.selectExpr("doc_id", "1 - quality"))  # every document marked both ways counts as good
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.fit(docs, tied, ["n_chars"]), ["n_chars"]).collect())


def test_quality_training_by_brute_force():
    """One step of the training on two documents against derivatives by small differences."""
    rng = np.random.default_rng(24)
    rows = [(np.array([1, 3, 5]), np.array([0.5, 1.0, 0.25], np.float32)), (np.array([1, 2]), np.array([1.0, 0.5], np.float32))]
    labels = np.array([1.0, 0.0])
    m = quality.Model(0.1, rng.standard_normal(8).astype(np.float64), rng.standard_normal((8, 3)).astype(np.float64))

    def loss(model):
        out = 0.0
        for (p, x), y in zip(rows, labels):
            s = 1 / (1 + np.exp(-model.margin(np.array([0, len(p)]), p, x)[0]))
            out -= y * np.log(s) + (1 - y) * np.log(1 - s)
        return out

    for place, factor in ((1, 0), (3, 2), (2, 1)):
        up, down = (quality.Model(m.bias, m.weights, m.factors.copy()) for _ in range(2))
        up.factors[place, factor] += 1e-6
        down.factors[place, factor] -= 1e-6
        slope = 0.0
        for (p, x), y in zip(rows, labels):
            s = 1 / (1 + np.exp(-m.margin(np.array([0, len(p)]), p, x)[0]))
            for k, v in zip(p, x):
                if k == place:
                    slope += (s - y) * v * ((x @ m.factors[p, factor]) - v * m.factors[place, factor])
        assert np.isclose((loss(up) - loss(down)) / 2e-6, slope, rtol=1e-4)


def test_factorisation_identity():
    rng = np.random.default_rng(9)
    m = quality.Model(0.3, rng.standard_normal(50).astype(np.float32), rng.standard_normal((50, 4)).astype(np.float32))
    places, x = np.array([3, 8, 20, 41]), np.array([0.5, 1.0, 2.0, 0.25], np.float32)
    slow = 0.3 + sum(m.weights[p] * v for p, v in zip(places, x))
    slow += sum(m.factors[places[i]] @ m.factors[places[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.margin(np.array([0, 4]), places, x)[0], slow, rtol=1e-5)


def test_language_model(spark):
    rng = random.Random(10)
    texts = [None, "", "A a", "x" * 20_000] + [" ".join(rng.choice(["the cat", "der hund", "a dog", "un chat"]) for _ in range(30)) for _ in range(60)]
    docs = table(spark, texts)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = maxent.score(docs, held).collect()
    tokens = {i: (x or "").encode().translate(LOW).split() + [None] for i, x in enumerate(texts)}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    own = [r for r in rows if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert maxent.score(docs.limit(0), held).count() == 0


def test_language_model_sums_to_one():
    rng = np.random.default_rng(11)
    w = maxent.Weights(14, [rng.standard_normal(s).astype(np.float32) for s in maxent.Weights.shapes(14)])
    buckets = np.arange(maxent.CLASSES * maxent.SLOTS)
    wide, narrow = np.tile([[5, 6, 7, 8]], (len(buckets), 1)), np.tile([[3, 4]], (len(buckets), 1))
    assert np.isclose((10 ** w.log10(wide, narrow, buckets)).sum(), 1, rtol=1e-4)


def slow_scores(texts, held, weights):
    """Scores word by word from the model's definition: features of the context, two softmaxes, counts within a bucket."""
    mix = lambda x: int(text_kernels.mix(np.array([x % 2**64], np.uint64))[0])
    end, start = (int(x) for x in text_kernels.stream(61, 2))

    def hashed(word):
        data = np.frombuffer(word, np.uint8)
        return int(text_kernels.hashes(data, np.array([0]), np.array([len(data)]), 62)[0])

    def bucket(word):
        if word is None:
            return 0
        tail = head = 0
        for k in range(3):
            tail = tail * 257 + (word[-1 - k] + 1 if k < len(word) else 0)
            head = head * 257 + (word[k] + 1 if k < len(word) else 0)
        return (mix(tail + 17) >> 32) % 32 * 32 + (mix(head + 99) >> 32) % 32

    tokens = [(x or "").encode().translate(LOW).split() + [None] for x in texts]
    counts = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    total, kinds = Counter(), Counter()
    for w, c in counts.items():
        total[bucket(w)] += c
        kinds[bucket(w)] += 1
    top, low = 64 - weights.bits, 64 - weights.bits + maxent.NARROWER

    def log_softmax(rows, at):
        x = sum(np.asarray(r, float) for r in rows)
        return x[at] - np.log(np.exp(x - x.max()).sum()) - x.max()

    out = []
    for x in tokens:
        h = [start] * 3 + [end if w is None else hashed(w) for w in x]
        score = 0.0
        for i, w in enumerate(x):
            one, two, three = h[i + 2], h[i + 1], h[i]
            keys = [mix(one + 1), mix(one * 3 + mix(two)), mix(two + 2), mix(three + 3)]
            b = bucket(w)
            c, s = divmod(b, 32)
            score += log_softmax([weights.classes[k >> top] for k in keys] + [weights.classes[-1]], c)
            score += log_softmax([weights.slots[(k >> low) * 32 + c] for k in (keys[0], keys[2])] + [weights.slots[len(weights.slots) - 32 + c]], s)
            score += math.log((counts[w] + 1) / (total[b] + kinds[b] + 1))
        out.append(score / math.log(10))
    return out


def test_language_model_score_by_brute_force(spark):
    texts = [None, "", "a B c", "the cat " * 20, "der hund", "x" * 100, "ends here", "a B c"]
    docs = table(spark, texts, [0, 1, 2, 3, 4, 5, 6, None])
    held = F.col("doc_id") % 3 == 2
    weights = maxent.train(docs.where("doc_id is null or doc_id % 3 <> 2"))
    assert weights.bits == 14 and np.abs(weights.classes).max() > 0
    expected = slow_scores(texts, [i % 3 == 2 for i in range(7)] + [False], weights)
    got = {r.doc_id: r.score for r in maxent.score(docs, held, weights).collect()}
    for i, x in zip([0, 1, 2, 3, 4, 5, 6, None], expected):
        assert math.isclose(got[i], x, rel_tol=1e-4), (i, got[i], x)


def test_language_model_is_the_same_for_any_partitions(spark):
    rng = random.Random(12)
    docs = table(spark, [sentence(rng, 40) for _ in range(120)] + ["same"] * 5)
    one, many = maxent.train(docs.repartition(1)), maxent.train(docs.repartition(9))
    assert np.array_equal(one.classes, many.classes) and np.array_equal(one.slots, many.slots)


def test_drawn_gradient_follows_the_softmax():
    rng = np.random.default_rng(13)
    w = maxent.Weights(14)
    w.classes[-1, :4] = [3, 2, 1, 0]
    noise = -np.log(rng.exponential(size=(200_000, 32))).astype(np.float32)
    drawn = (w.classes[np.full(200_000, len(w.classes) - 1)] + noise).argmax(1)
    p = np.exp(w.classes[-1]) / np.exp(w.classes[-1]).sum()
    assert np.allclose(np.bincount(drawn, minlength=32) / 200_000, p, atol=4e-3)


def test_training_pieces_do_not_depend_on_batches():
    import pyarrow as pa

    texts = pa.array([("w%d " % i) * 400 for i in range(6000)], pa.large_string())
    start = [np.zeros(s, np.float32) for s in maxent.Weights.shapes(14)]
    made = []
    for cut in (6000, 700):
        learner = maxent._Learner(0, start, 14)
        for lo in range(0, 6000, cut):
            learner.add(texts.slice(lo, cut))
        learner.learn()
        made.append(learner.weights.classes)
    assert np.array_equal(*made)


def confusable(n=1024):
    """A Thue-Morse word and its complement: equal under any polynomial modulo 2**64."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse():
    for n in (256, 512, 1024, 2048):
        data = np.frombuffer("".join(confusable(n)).encode(), np.uint8)
        for seed in (11, 14, 21, 41, 51, 62):
            one, two = text_kernels.hashes(data, np.array([0, n]), np.array([n, 2 * n]), seed)
            assert one != two


def test_texts_with_confusable_words(spark):
    x, y = confusable()
    shared = [f"s{i}" for i in range(12)]
    texts = [" ".join(shared[:6] + [x] + shared[6:]), " ".join(shared[:6] + [y] + shared[6:])]
    assert [r.n_removed for r in substring_dedup.remove_repeats(table(spark, texts)).collect()] == [0, 0]
    assert sorted(r.component_id for r in near_dedup.near_duplicates(table(spark, [f"{t} {t}" for t in texts] + ["q"]), 3, 85).collect()) == [0, 1, 2]


def test_store(spark, tmp_path):
    docs = table(spark, edge_texts() + ["again", "again"], [*range(16), 99, 99])
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=200_000)
    assert store.manifest() == (0, [])
    for k in range(5):
        store.append(docs.where(f"doc_id % 5 = {k}").repartition(2))
    before, (_, shards) = store.manifest()[0], store.manifest()
    compacted = store.compact()
    assert compacted == before + 1 and len(store.manifest()[1]) < len(shards)
    rows = lambda df: Counter(map(tuple, df.collect()))
    for version in (before, compacted):
        assert rows(store.read(version)) == rows(docs)
    assert store.compact() == compacted
    with pytest.raises(RuntimeError):
        store.commit(before, shards, "late writer")
    merged = [x.bytes for x in store.manifest()[1]]
    assert all(b <= 2 * store.target for b in merged)
    assert {r.place for r in store.read(shard="place").collect()} == {x.file for x in store.manifest()[1]}
    with pytest.raises(ValueError):
        store.read(shard="Tie")


def test_vacuum_spares_writers_and_versions(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=1 << 20, fanout=2)
    make = lambda i: spark.createDataFrame([(i, "x")], "doc_id long, text string").coalesce(1)
    for i in range(4):
        store.append(make(i))
    before, late = store.manifest()[0], f"{store.root}/data/00000009-late"
    store.compact()
    make(9).write.parquet(late)  # a writer that has not committed yet
    assert store.vacuum() == 0 and store.read(before).count() == 4
    assert store.vacuum(keep=1, grace=0) == 5 and store.read().count() == 4 and not (tmp_path / "s" / "data" / "00000009-late").exists()


def test_tiers_wait_for_enough_shards(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=1000, fanout=4)
    shards = lambda sizes: [sharding.Shard(f"data/f/{i}", b, 1) for i, b in enumerate(sizes)]
    sizes = lambda sizes_: [[x.bytes for x in run] for run in store.plan(shards(sizes_))]
    assert sizes([1, 450]) == [] and sizes([1, 450, 200]) == [] and sizes([40] * 3) == [] and sizes([600, 900]) == []
    assert sizes([40] * 4 + [300]) == [[40] * 4]
    assert sizes([300] * 5) == [[300] * 3] and sizes([300] * 7) == [[300] * 3, [300] * 3]


def test_manifests_hold_changes_only(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=1 << 20)
    make = lambda i: spark.createDataFrame([(i, "x")], "doc_id long, text string").coalesce(1)
    for i in range(18):
        store.append(make(i))
    sizes = [(tmp_path / "s" / "manifests" / f"{v:08d}.json").stat().st_size for v in (2, 16, 17, 18)]
    assert abs(sizes[0] - sizes[1]) < 20 and sizes[2] > 3 * sizes[3]
    for v in (1, 5, 16, 17, 18):
        assert store.read(v).count() == v


def test_ingest_leaves_no_row_out(spark, tmp_path):
    docs = table(spark, ["a", None, "", "b", "b", "z" * 300_000], [1, 2, None, 3, 3, 4])
    rows = lambda df: Counter(map(tuple, df.collect()))
    store = sharding.ingest(docs, [F.col("doc_id") > 2, F.col("doc_id") > 1], str(tmp_path / "a"), 1 << 20)
    assert rows(store.read()) == rows(docs)
    assert sharding.ingest(docs, [], str(tmp_path / "b"), 1 << 20).read().count() == 6
    empty = sharding.ingest(docs.limit(0), [F.col("doc_id") > 2], str(tmp_path / "c"), 1 << 20)
    assert empty.manifest()[0] >= 2 and (not empty.manifest()[1] or empty.read().count() == 0)


def test_store_keeps_further_columns(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=2048, fanout=3)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1))
    first = store.append(spark.createDataFrame([(2, "b", 7)], "doc_id long, text string, extra int").coalesce(1))
    store.append(spark.createDataFrame([("c",)], "text string").coalesce(1))
    whole = [(None, "c", None), (1, "a", None), (2, "b", 7)]
    rows = lambda: sorted(map(tuple, store.read().select("doc_id", "text", "extra").collect()), key=str)
    assert rows() == sorted(whole, key=str)
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "extra string"))
    store.compact()
    store.vacuum(keep=1, grace=0)
    assert len(store.manifest()[1]) < 3 and rows() == sorted(whole, key=str)
    assert store.schema(first).names == ["doc_id", "text", "extra"]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "call +1 (663) 555-6869 now please friend", "en", "s", 41)], docs.schema)
    docs, kept = docs.union(extra), []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True)
    assert not docs.where(F.col("text").contains("555-6869")).count()
    last = p.tokens_stage(spark, docs, sf).collect()
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, r.text) for r in last) == texts
    whole = p.run(spark, sf)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in last if r.doc_id is not None and r.doc_id < 9000}
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_keeps_further_columns_and_long_texts(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    long = " ".join(f"w{i % 9973}" for i in range(150_000))
    docs = docs.union(spark.createDataFrame([(7001, long, "en", "s", len(long)), (7002, long, "en", "s", len(long))], docs.schema))
    for name in ("score", "k0", "__found", "found", "token_ids", "root", "a", "b", "__bad", "text_"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in p.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.where("doc_id >= 7000").collect()
        assert [r.doc_id for r in rows] == [7001] if name == "near_dedup" else len(rows) == 2, name
        assert all(r.text == long and r["__found"] == "__found" and r.score == "score" for r in rows)
    kept = p.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert p.tokens_stage(spark, docs, sf).count() == docs.count()


def test_queries_of_operators_without_sql(spark, sf):
    """The registered queries themselves, with their contracted columns, on the whole table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    leaks = queries.op1_decontaminate(spark, sf).collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    flat = {i: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for i, t in texts.items()}
    whole = {(i, j) for j, x in items.items() for i, t in flat.items() if " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split()) in t}
    assert whole <= {(r.doc_id, r.item_id) for r in leaks}
    private = {r.doc_id: r for r in queries.op2_pseudonyms(spark, sf).collect()}
    assert private.keys() == texts.keys() and all(r.text == texts[i] for i, r in private.items() if not any(r[f"n_{k}"] for k in pseudonyms.KINDS))
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scores = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in scores.items())
    aside = [i for i in marked if scores[i].held_out]
    assert sum(scores[i].predicted == marked[i] for i in aside) >= 0.8 * len(aside)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op6_bpe(spark, sf).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in learned for w in texts[i].encode().translate(LOW).split() + [None])
    n, v = sum(counts.values()), len(counts)
    for r in queries.op7_maxent(spark, sf).collect():
        t = texts[r.doc_id].encode().translate(LOW).split() + [None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, r.doc_id not in set(learned))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r.score < 0


def test_bpe_of_repeated_rows(spark):
    rows = bpe.encode(table(spark, ["a b", "a b", None, "x" * 3_000_000], [1, 1, 2, 3]), RANKS, PATTERN, decoded=True).collect()
    assert len({(r.n_tokens, bytes(r.token_ids)) for r in rows if r.doc_id == 1}) == 1 and len(rows) == 4
    assert [bytes(r.decoded) for r in rows if r.doc_id == 3] == [b"x" * 3_000_000]


def test_sketches_lose_no_pair_at_the_threshold():
    """The share of pairs at the threshold whose sketches differ in more bits than allowed, by simulation."""
    rng = np.random.default_rng(25)
    for s, n in ((0.85, 240), (0.8, 384)):
        limit = near_dedup.sketch_limit(s, n)
        bits = np.where(rng.random((20_000, n)) < s, 0, rng.binomial(4, 0.5, (20_000, n))).sum(1)
        low = np.where(rng.random((20_000, n)) < s - 0.25, 0, rng.binomial(4, 0.5, (20_000, n))).sum(1)
        assert (bits > limit).mean() <= 1e-4 and (low <= limit).mean() < 0.05


def test_near_duplicates_below_the_threshold_form_no_pairs(spark):
    """A large group of texts of which each two resemble one another a little: no links, and few pairs are compared."""
    rng = random.Random(26)
    base = sentence(rng, 120, 100_000).split()
    texts = []
    for _ in range(150):
        copy = list(base)
        for i in rng.sample(range(len(copy)), 6):
            copy[i] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [shingles(x, 3) for x in texts]
    links = sum(100 * len(a & b) >= 85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    rows = near_dedup.near_duplicates(table(spark, texts), 3, 85).collect()
    assert sum(r.kept for r in rows) == 150 - links if links < 3 else True
    assert len(rows) == 150


def test_digest_columns(spark, sf):
    row = queries.op8_substring_dedup(spark, sf).where("doc_id = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 0").first().text
    assert row.n_removed or row.kept_sha256 == hashlib.sha256(b" ".join(words(text))).hexdigest()


def embeddings(spark, vectors, ids=None, labels=None):
    """Vectors with further columns whose names clash with those of the operators."""
    n = len(vectors)
    rows = zip(range(n) if ids is None else ids, vectors, [0] * n if labels is None else labels, ["x"] * n, [7] * n, [1.5] * n, ["c"] * n)
    return spark.createDataFrame(list(rows), "vec_id long, embedding array<double>, label int, v string, cluster int, upper double, code string")


def odd_vectors(dims, n, seed=5, scale=1.0):
    """Vectors with copies, ties, and rows that take no part: nulls, null and non-finite components, other lengths, huge values."""
    rng = random.Random(seed)
    out = [[rng.choice([rng.gauss(0, scale), rng.randrange(-2, 3) / 4]) for _ in range(dims)] for _ in range(n)]
    for i in range(0, n, 7):
        out[i] = list(out[0])
    bad = [None, [None] * dims, [math.nan] + [0.0] * (dims - 1), [math.inf] * dims, [-math.inf] + [1.0] * (dims - 1)]
    return out + bad


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for j, own in groups.items():
                books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return out, digest


def test_vector_codes(spark):
    vectors = odd_vectors(8, 150)
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(vectors))]
    ids = [10 * (i * 37 % 157) for i in range(len(vectors))]
    for parts, entries in ((4, 16), (8, 3), (2, 64)):
        want, digest = plain_codes(list(zip(ids, vectors, labels)), parts, entries, 2, 256)
        for slices in (1, 5):
            coded, books = vector_codes.compress(embeddings(spark, vectors, ids, labels).repartition(slices), parts, entries, 2, 256)
            assert sorted((r.vec_id, r.code, r.error, r.label) for r in coded.collect()) == sorted(want, key=lambda r: r[0])
            assert books.sha256() == digest
        sums = Counter()
        for _, _, error, label in want:
            sums[label] += error
        got = vector_codes.with_sum(coded, "label", "error", "label_error").collect()
        assert len(got) == len(want) and all(r.label_error == sums[r.label] for r in got)


def test_vector_codes_on_odd_tables(spark, monkeypatch):
    empty, books = vector_codes.compress(embeddings(spark, []))
    assert empty.count() == 0 and vector_codes.with_sum(empty, "label", "error", "s").count() == 0 and not books.books.size
    assert vector_codes.compress(embeddings(spark, [None, [math.nan]]))[0].count() == 0
    mixed = [[0.5] * 32, [0.5] * 32, [1.0] * 3, [1e30] * 32, [], [0.25] * 64]
    got = sorted(vector_codes.compress(embeddings(spark, mixed, [4, None, 1, 2, 3, 9]))[0].collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    assert [(r.vec_id, r.code, r.error) for r in got] == [(1, None, None), (2, None, None), (3, None, None), (4, "00" * 16, 0), (9, None, None), (None, "00" * 16, 0)]
    rng = random.Random(1)
    keyed = [(i, rng.choice([None, 1, rng.randrange(50)]), rng.randrange(9)) for i in range(300)]
    want = Counter()
    for _, k, x in keyed:
        want[k] += x
    monkeypatch.setattr(vector_codes, "HOT", 8)  # more keys than that: the frequent ones by broadcast, the rest by a shuffled join
    rows = vector_codes.with_sum(spark.createDataFrame(keyed, "id int, k int, x int"), "k", "x", "total").collect()
    assert sorted(r.id for r in rows) == list(range(300)) and all(r.total == want[r.k] for r in rows)


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept)][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept), centres


@pytest.mark.parametrize("k, rounds, dims, scale", [(8, 10, 6, 1024), (3, 2, 4, 4), (200, 3, 2, 8), (1, 3, 6, 1024), (5, 0, 6, 16)])
def test_clusters(spark, k, rounds, dims, scale):
    vectors = odd_vectors(dims, 160, seed=dims + k) + [[0.0] * (dims + 1), []]
    want, centres = plain_clusters(list(enumerate(vectors)), k, rounds, dims, scale, "3")
    out, found = elkan.cluster(embeddings(spark, vectors).repartition(3), k, rounds, dims, scale)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out.collect()) == want
    assert found.centroids.tolist() == centres
    sums = Counter()
    for _, j, d in want:
        sums[j] += d
    for r in elkan.with_inertia(out, found).collect():
        digest = hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
        assert (r.cluster_inertia, r.inertia, r.centroid_sha256) == (sums[r.cluster], sum(sums.values()), digest)
    if rounds == 10:  # bounds rule most distances out
        assert sum(found.tried) < 0.6 * len(want) * k * len(found.tried)


def test_clusters_on_odd_tables(spark):
    out, found = elkan.cluster(embeddings(spark, []))
    assert elkan.with_inertia(out, found).count() == 0
    out, found = elkan.cluster(embeddings(spark, [[1e30, 0.0], [0.5, 0.5], [0.5, 0.5], [2.0, 2.0], None], [1, 2, None, 2, 5]), 2, 3, 2, 4)
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.inertia) for r in elkan.with_inertia(out, found).collect())
    assert [g[0] for g in got] == ["1", "2", "2", "None"] and got[0][1:] == (None, None, 0) and all(g[2] == 0 for g in got[1:])
    alone, found = elkan.cluster(embeddings(spark, [[1e30, 0.0]]), 2, 3, 2, 4)
    assert [(r.cluster, r.inertia) for r in elkan.with_inertia(alone, found).collect()] == [(None, 0)]


TOKENIZER = path("byte_bpe_50k.json")


def id_blocks(rng):
    """Blocks of every kind: one id, repeats, all different, learnt and unlearnt lengths, the longest."""
    ids = rng.zipf(1.3, 30_000) % 50_257
    blocks = [ids[i : i + n] for i, n in ((0, 1), (1, 2), (5, 127), (9, 128), (9, 129), (50, 256), (77, 1000), (0, 8192), (300, 5000))]
    return [*blocks, np.zeros(8192, int), np.arange(8192), np.arange(8192)[::-1] * 6, np.full(3, 50_256), np.tile(np.arange(700), 11)]


@pytest.mark.parametrize("lanes", [3, 1024])
def test_id_coder_round_trip(monkeypatch, lanes):
    monkeypatch.setattr(id_coder, "ENCODED", lanes)
    monkeypatch.setattr(id_coder, "DECODED", 2 * lanes)
    prior, blocks = id_coder.Prior(50_257), id_blocks(np.random.default_rng(2))
    codes = id_coder.encode(blocks, prior)
    assert codes == [id_coder.encode([b], prior)[0] for b in blocks]  # each block stands alone
    for got, want in zip(id_coder.decode(codes, list(map(len, blocks)), prior), blocks):
        assert got.tolist() == want.tolist()
    assert len(codes[9]) < 8192 / 24 and len(codes[13]) < 0.5 * 2 * 7700  # what repeats costs little against two bytes an id
    wide = id_coder.Prior(1 << 20)
    far = [np.array([(1 << 20) - 1, 0, 5] * 400), np.arange(1 << 19, (1 << 19) + 3000)]
    assert [x.tolist() for x in id_coder.decode(id_coder.encode(far, wide), [1200, 3000], wide)] == [x.tolist() for x in far]
    assert id_coder.encode([], prior) == [] and id_coder.decode([], [], prior) == []


def test_carries_reach_the_words_before():
    rng, prior = np.random.default_rng(7), id_coder.Prior(3)
    for n in (400, 2000):
        blocks = [rng.choice(3, n, p=p) for p in ([0.98, 0.01, 0.01], [0.01, 0.01, 0.98], [0.4, 0.3, 0.3]) for _ in range(100)]
        assert all((a == b).all() for a, b in zip(id_coder.decode(id_coder.encode(blocks, prior), [n] * 300, prior), blocks))


def token_texts():
    rng = random.Random(8)
    odd = ["", " ", "\n\n \t x", "a  b   c \n d", "  　 x   y  ", "it's we'll  1234 5", "中文 文字。 。", "é \u0085 z\x1c \x1d q", "<|endoftext|> <|endoftext|>x", "é é  é   é", "x" * 30_000, "     a  b  c  d  e"]
    made = ["".join(rng.choice([" ", "  ", "\n", " ", "　", "ab", "Ü", "語", "'s", "9", "!", "\x85", "\x1f"]) for _ in range(60)) for _ in range(40)]
    return [*odd, *made, sentence(rng, 20_000), None]


def test_encoder_equals_whole_texts():
    with open(TOKENIZER, encoding="utf-8") as f:
        made = token_files.Encoder(f.read())
    assert made.cut
    plain = tokenizers.Tokenizer.from_file(TOKENIZER)
    texts = token_texts()
    for own in (texts, texts[:1], [None], ["a"], []):
        ids, sizes = made.encode(pa.array(own, pa.string()))
        want = [plain.encode(x or "", add_special_tokens=False).ids for x in own]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    for changed in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        assert not token_files.cuts_are_safe({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}} | changed)


@pytest.mark.parametrize("block, part_bytes", [(64, 20_000), (8192, 48 << 20), (1, 1 << 20)])
def test_token_files(spark, block, part_bytes, tmp_path):
    texts = token_texts() if block > 1 else token_texts()[:9]
    ids = [None if i == 3 else 7 if i in (4, 5) else 1000 - 3 * i for i in range(len(texts))]
    with open(TOKENIZER, encoding="utf-8") as f:
        tokenizer = f.read()
    token_files.write(table(spark, texts, ids).repartition(5), tokenizer, str(tmp_path / "f"), end=0, block=block, part_bytes=part_bytes)
    plain = tokenizers.Tokenizer.from_file(TOKENIZER)
    coded = {i: np.array([*plain.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, x in enumerate(texts)}
    got = sorted(token_files.documents(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert len(got) == len(texts) and [r.doc_id for r in got] == sorted(ids, key=lambda x: (x is not None, x))
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((ids[i], len(x) // 4, zlib.crc32(x)) for i, x in coded.items())
    if block == 64:
        whole = {}
        for r in sorted(token_files.pieces(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: (r.part, r.at)):
            whole[(r.part, r.doc)] = (r.doc_id, whole.get((r.part, r.doc), (0, b""))[1] + bytes(r.ids))
        assert Counter(whole.values()) == Counter((ids[i], x) for i, x in coded.items())
        damaged = spark.read.parquet(str(tmp_path / "f")).withColumn("crc", F.col("crc") + 1)
        damaged.write.parquet(str(tmp_path / "g"))
        with pytest.raises(Exception, match="damaged"):
            token_files.pieces(spark, str(tmp_path / "g")).count()


def test_token_files_of_nothing(spark, tmp_path):
    with open(TOKENIZER, encoding="utf-8") as f:
        token_files.write(table(spark, []), f.read(), str(tmp_path / "f"))
    assert token_files.documents(spark, str(tmp_path / "f")).count() == 0


def test_joined_crc():
    rng = random.Random(3)
    for n in (0, 1, 5, 4096, 100_003):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(n)
        assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_op13_equals_the_library(spark, sf):
    plain, at, want = tokenizers.Tokenizer.from_file(TOKENIZER), 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.QUERIES["op13_token_files"](spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, got.collect())) == want

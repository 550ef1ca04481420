"""Collocations, ranked search and personal data against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "a b", "é", "12 34", "word " * 30_000, "É.é,\x00x", "A,b;C"]


def frame(spark, rows, schema=DOCS):
    """Rows with clashing extra columns in front of and behind them."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select(F.lit(1).alias("n"), F.lit("x").alias("phrase"), F.lit(2).alias("row"), "*", F.lit("y").alias("score"), F.lit("z").alias("a"), F.lit(3).alias("id"))


def texts(rng, n, most=60, of=12):
    return [" ".join(rng.choice("abcdefghijkl"[:of]) * rng.randrange(1, 3) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(rng.randrange(most))) for _ in range(n)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- collocations


def brute_collocations(rows, max_n, least, share, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            held = any(len(q) > len(p) and b >= least and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items())
            if not held:
                score, _, left, right = min(((10**6 * a * a) // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("max_n, least, share, top", [(3, 10, 50, 2000), (4, 3, 60, 20), (2, 5, 50, 7), (3, 1, 10, 50)])
def test_collocations_equal_brute_force(spark, max_n, least, share, top):
    from varigrid.llm.collocations import collocations

    rng = random.Random(max_n * 100 + least)
    some = texts(rng, 40, of=6 if least > 1 else 12) + ["New York, new york! New  York\tcity"] * 12 + ODD[:7] + ODD[8:]
    rows = [(i, t, rng.choice(["en", "de", None, "und", "En"]), "s", 0) for i, t in enumerate(some)]
    rows += rows[:5]
    got = collocations(frame(spark, rows), max_n, least, share, top, salts=3)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations([(r[2], r[1]) for r in rows], max_n, least, share, top)


def test_collocations_of_long_texts_and_none(spark):
    from varigrid.llm.collocations import collocations

    long = "x y " * 200_000
    rows = collocations(frame(spark, [(1, long, "en", "s", 0), (None, None, None, None, None)]), top=5).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in rows] == [(p, 199_999, 200_000, 200_000, 400_000) for p in ("x y x", "y x y")]
    assert collocations(frame(spark, [])).collect() == []


def test_collocation_scores_pass_64_bits(spark):
    """Counts of 10**12 as they would come from a large corpus: the score's column takes them exactly."""
    from pyspark.sql import functions as F

    whole = "CAST({} AS DECIMAL(16, 0))".format
    expr = f"({whole('a')} * {whole('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({whole('l')} * {whole('r')})"
    a, left, right = 987_654_321_987, 9_876_543_219_871, 1_234_567_891_234
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(F.expr(expr)).first()[0]
    assert got == 10**6 * a * a // (left * right)


# -- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def brute_ranked(docs, items, k):
    found = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w in df}
    out = []
    for item, text in items:
        scored = []
        for doc, t in found:
            if not t:
                continue
            tf, m = Counter(t), 25 + (75 * len(t) * n) // total
            score = sum(weight[w] * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in terms(text) if w in tf)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        for rank, (score, has, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc if has else None, -score))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_ranked_equals_brute_force(spark, seed, monkeypatch):
    from varigrid.llm import treaps

    rng = random.Random(seed)
    some = texts(rng, 150, most=30) + ["a b c"] * 40 + ODD
    docs = [(i if i != 7 else None, t) for i, t in enumerate(some)]
    rng.shuffle(docs)
    docs += docs[:6]
    items = [(i, t) for i, t in enumerate([*texts(rng, 12, most=10), "a a b b b", "a b c", None, "", "unknown words", "É a", *ODD])]
    items.append(items[3])
    if seed % 2:  # small blocks, batches and rounds
        for name, value in (("BLOCK", 16), ("ITEMS", 3), ("PAIRS", 10), ("ROUND_TERMS", 20)):
            monkeypatch.setattr(treaps, name, value)
    got = treaps.ranked(frame(spark, [(i, t, "en", "s", 0) for i, t in docs]), frame(spark, items, "item_id long, text string"), k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_ranked(docs, items, 5), key=str)


def test_treaps_are_heaps_and_prune():
    """Parents weigh as much as what is under them, order is by document, and a search scores few documents."""
    import numpy as np

    from varigrid.llm.treaps import Best, Block, search

    rng = np.random.default_rng(3)
    n, lists = 4000, [np.sort(rng.choice(4000, size, replace=False)) for size in (3000, 900, 200, 4000)]
    term, doc = np.repeat(np.arange(4), [len(x) for x in lists]), np.concatenate(lists)
    impact = (rng.pareto(2, len(doc)) * 1000).astype(np.int64) + 1
    impact[term == 3] = 5  # all equal: still no chain
    block = Block(np.arange(n) * 3, term, doc, impact, 4)
    for side in (block.left, block.right):
        has = np.flatnonzero(side >= 0)
        assert (block.impact[side[has]] <= block.impact[has]).all()
    assert (block.doc[block.left[block.left >= 0]] < block.doc[np.flatnonzero(block.left >= 0)]).all()
    depth, level = 0, block.root[3:]
    while len(level):
        depth, level = depth + 1, np.concatenate([block.left[level], block.right[level]])
        level = level[level >= 0]
    assert depth < 60
    best = Best(1, 10)
    scored = search(block, np.zeros(4, np.int64), np.arange(4), np.array([3, 20, 50, 1]), best)
    total = np.zeros(n, np.int64)
    for t, w in enumerate([3, 20, 50, 1]):
        total[doc[term == t]] += w * impact[term == t]
    want = sorted(zip(-total, np.arange(n) * 3, strict=True))[:10]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist(), strict=True)] == [(int(a), int(b)) for a, b in want]
    assert scored < n / 4


def test_ranked_of_empty_tables(spark):
    from varigrid.llm.treaps import ranked

    items = frame(spark, [(1, "a")], "item_id long, text string")
    assert ranked(frame(spark, []), items).collect() == []
    assert ranked(frame(spark, [(1, "a", "en", "s", 0)]), frame(spark, [], "item_id long, text string")).collect() == []
    assert ranked(frame(spark, [(1, None, "en", "s", 0)]), items).collect() == []


# -- personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_sum(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def brute_base(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn_sum(digits) == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_personal_data_equals_the_rules(spark):
    from varigrid.llm.personal import personal_data

    rng = random.Random(2)
    parts = ["a", "é", "@", ".", "-", " ", "+", "1", "25", "4", "(", ")", "_", "4111111111111111", "b.c", "12.3", "256", "+1 (208) 555-1177", "\n", "x@y.zz", "ß", "://", "iban"]
    some = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(some)] + [(None, "q@r.st", None, None, None), (3, "q@r.st", None, None, None), (3, "q@r.st", None, None, None)]
    got = personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, *_ in rows:
        want = brute_base(t)
        r = next(r for r in by[i] if r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest())
        kinds = Counter(s.split(":")[0] for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in RULES)
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in RULES] == want
    assert personal_data(frame(spark, [])).collect() == []


@pytest.mark.parametrize("text, kind, span", [
    ("é mail bob.x (at) example (dot) com now", "hidden_email", "bob.x (at) example (dot) com"),
    ("bob[at]example.com", "hidden_email", "bob[at]example.com"),
    ("get ftp://joe:pw@host/x", "login", "joe:pw@host"),
    ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
    ("IBAN: DE88 3704 0044 0532 0130 00.", "iban", None),
    ("Account no. 12345678, paid", "account", "12345678"),
    ("Konto: 12-34 5678", "account", "12-34 5678"),
    ("discount 12345678", "account", None),
    ("+1 (208) 555-1177 4284896609045836", "account", "4284896609045836"),
    ("1 4111-1111-1111-1111 2", "account", "4111-1111-1111-1111"),
    ("http://host.org/a@b", "login", None),
])
def test_added_spans(text, kind, span):
    from varigrid.llm.personal import _row

    spans = [s.split(":") for s in _row(text.encode())[2].split(",") if s]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == kind] == ([span] if span else [])


def test_personal_data_takes_linear_time():
    import time

    from varigrid.llm.personal import found_in

    for unit in ("1", "a", "a@b.", "1.2.", "+1", "a@", "1 ", "x://a:", "(at)a", "iban de12 "):
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            found_in(unit.encode() * n + b"@")
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 1


# -- main text: what is no template stays


@pytest.mark.parametrize("html, text", [
    ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here</p></article>", "Energy is E=m here"),
    ("<article><p>So <math><semantics><mi>x</mi><annotation encoding='t'>\\x</annotation></semantics></math>.</p></article>", "So x."),
    ("<body><div class='social-science'><p>A study.</p></div></body>", "A study."),
    ("<body><div class='ad-hoc'><p>A team.</p></div></body>", "A team."),
    ("<body><div class='share-price'><p>It rose.</p></div><div class='site-footer'>c</div></body>", "It rose."),
    ("<body><div class='related-posts'><a>x</a></div><div id='cookie-banner'>ok</div><p>Text</p></body>", "Text"),
    ("<article><p>One</p><aside><p>A quotation of hers.</p></aside><p>Two</p></article>", "One\nA quotation of hers.\nTwo"),
    ("<article><p>One</p><aside><a href='x'>More of this</a></aside></article>", "One"),
    ("<article><p>One</p><aside class='ad'>Buy</aside></article>", "One"),
    ("<aside>Side</aside><main><p>One</p></main>", "One"),
])
def test_article_text_stays(html, text):
    from varigrid.llm.webtext import Page

    assert Page(html).text()[0] == text


def test_marked_elements_go_by_their_count(spark):
    """The same class word: a footer's on many pages goes, an article's on one stays."""
    from varigrid.llm.webtext import main_text

    page = "<body><p>Text of page {0}.</p><div class='widget-of-the-day'>Tip {0} to be had</div></body>"
    rows = [(i, f"http://many.org/{i}", page.format(i)) for i in range(12)] + [(99, "http://few.org/1", page.format(99))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text of page {i}." for i in range(12)) and got[99] == "Text of page 99.\nTip 99 to be had"


# -- re-parameterised benchmark items


def reparameterised(seed=4):
    """(item, its text with other names, numbers in words or digits, and units written in another way)."""
    rng = random.Random(seed)
    names, more = ["Tom", "Anna", "Priya", "Louis"], ["Sam", "Maria", "Chen", "Olga"]
    digits = {2: "two", 5: "five", 12: "twelve", 25: "twenty-five", 40: "forty", 130: "one hundred and thirty"}
    forms = [
        "{n} has {a} apples and gives {b} of them to {m} , so how many are left at the end of day ?",
        "{n} walks {a} km to the market while {m} rides {b} km from there ; what is the way of both ?",
        "A bag of {a} kg costs as much as {b} small boxes that {n} bought for {m} last week in town",
        "In {a} days {n} reads {b} pages of the book that {m} once lent out ; how long does the rest take ?",
        "The tank holds {a} liters and loses {b} of these each hour until {n} and {m} close the valve again",
    ]
    out = []
    for i in range(30):
        form = forms[i % len(forms)] + f" part{'abcdefghij'[i % 10]} section{'xyz'[i // 10]}"
        a, b = rng.sample(sorted(digits), 2)
        (n, m), (x, y) = rng.sample(names, 2), rng.sample(more, 2)
        item = form.format(n=n, m=m, a=a, b=b)
        a, b = rng.sample(sorted(digits), 2)
        copy = form.format(n=x, m=y, a=digits[a] if i % 2 else a, b=digits[b] if i % 3 else b)
        out.append((item, re.sub(r"(\d+) (km|kg|days|liters)", r"\1-\2", copy) if i % 4 == 0 else copy))
    return out


def test_reparameterised_items_are_found(spark):
    from varigrid.llm.decontaminate import contamination

    pairs = reparameterised()
    bench = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(pairs)], "item_id long, text string")
    clean = "Some plain text about one or two walks that Tom and Anna took in twelve days without a word of the rest of it ."
    rows = [(i, f"Some words before. {copy} And some after.") for i, (_, copy) in enumerate(pairs)] + [(1000, clean)]
    got = {r.doc_id: r["items"] for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert sum(i in got[i] for i in range(len(pairs))) >= 0.9 * len(pairs)
    assert got[1000] == []


def test_numbers_in_words_and_units(spark):
    from pyspark.sql import functions as F

    from varigrid.llm.decontaminate import tokens

    texts = ["Sam has twelve apples", "twenty-five kg or 5-kg bags", "One hundred and six of someone", "the phone rang", "ten, two"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokens(F.col("t"))).collect()]
    assert got == [["##sam", "has", "0twelve0", "apples"], ["0twenty_five0", "@kg", "or", "5", "@kg", "bags"], ["0one_hundred_six0", "of", "someone"], ["the", "phone", "rang"], ["0ten0", "0two0"]]


# -- language sets: the greedy choice against all sets


def test_language_sets_against_all_sets():
    """Every set of languages with the best proportions on a grid, by penalised likelihood."""
    from itertools import combinations

    import numpy as np

    from varigrid.llm.language import BITS, PENALTY, Model

    rng = np.random.default_rng(6)
    counts = np.zeros((3, 1 << BITS), np.int64)
    for k in range(3):
        counts[k, rng.choice(60, 25, replace=False)] = rng.integers(50, 3000, 25)
    model = Model(["a", "b", "c"], counts)
    steps = np.linspace(0.02, 0.98, 25)
    for _ in range(40):
        truth = rng.dirichlet([0.4, 0.4, 0.4])
        n = int(rng.integers(30, 400))
        grams = np.concatenate([rng.choice(1 << BITS, int(round(n * t)), p=model.p[:, k]) for k, t in enumerate(truth)]).astype(np.int64)
        if not len(grams):
            continue
        c = np.bincount(grams, minlength=1 << BITS)
        u = np.flatnonzero(c)
        p, c = model.p[u], c[u]
        best = -np.inf
        for size in (1, 2, 3):
            for members in combinations(range(4), size):
                shares = [(1.0,)] if size == 1 else [(x, 1 - x) for x in steps] if size == 2 else [(x, y, 1 - x - y) for x in steps for y in steps if x + y < 0.99]
                like = max(float(c @ np.log(p[:, members] @ np.array(s))) for s in shares)
                best = max(best, like - (size - 1) * PENALTY * np.log(c.sum() + 1.0))
        share, likeliest = model.mixture(grams)
        mine = float(c @ np.log(p @ share)) - (np.count_nonzero(share) - 1) * PENALTY * np.log(c.sum() + 1.0)
        assert mine >= best - 0.5 and abs(share.sum() - 1) < 1e-9
        assert likeliest == int(np.argmax([float(c @ model.logp[u][:, k]) for k in range(3)]))


# -- toxicity: scores and the fit against plain Python

_ALL = (1 << 64) - 1


def mixed64(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def plain_buckets(text, sizes, bits):
    """Buckets of a text's different n-grams of letters, words apart by one gap and gaps at both ends."""
    code = [0]
    for ch in text or "":
        c = ord(ch.lower() if len(ch.lower()) == 1 else ch) if ch.isalpha() else 0
        if c or code[-1]:
            code.append(c)
    if code[-1]:
        code.append(0)
    out = set()
    for i in range(len(code)):
        acc = 1
        for k in range(max(sizes)):
            if i + k >= len(code):
                break
            acc = mixed64((acc + 0x9E3779B97F4A7C15 + code[i + k]) & _ALL)
            if k + 1 in sizes:
                out.add(mixed64((acc + k) & _ALL) >> (64 - bits))
    return out


def test_toxicity_scores_and_fit_in_plain_python(spark):
    from varigrid.llm import toxicity as tox

    rng = random.Random(12)
    mean, kind = ["you vile worm", "rotten scum of earth", "filthy liar go"], ["lovely day in town", "the tea was warm", "we walked to the lake"]
    rows = []
    for i in range(120):
        words = " ".join(rng.choice(kind) for _ in range(rng.randrange(1, 5)))
        rows.append((i, f"{words}, {rng.choice(mean)}! {words}" if i % 4 == 0 else words, int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, ""), (901, None), (902, "É, Ab!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    found = {r.doc_id: r.score for r in tox.scored(docs, model, "doc_id").collect()}
    held = {i: plain_buckets(t, range(tox.LEAST, tox.MOST + 1), tox.BITS) for i, t, _ in [*rows, (900, "", 0), (901, None, 0), (902, "É, Ab!", 0)]}
    for i, b in held.items():
        z = model.bias + float(sum(model.weights[x] for x in b))
        assert found[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    # the weights are where the balanced loss is all but flat
    share = {0: 0.5 / 90, 1: 0.5 / 30}
    slope = sum(share[y] * (found[i] - y) for i, _, y in rows)
    assert abs(slope) < 1e-2
    assert min(found[i] for i, _, y in rows if y) > max(found[i] for i, _, y in rows if not y)

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, mixing, secrets

DOCS = "doc_id long, text string, kind string, start int, out string"


def brute_base(text):
    out = []
    kw = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({kw})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, p, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text) if m.end() - m.start() >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def secret_rows():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base62 = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    texts = [None, "", " ", "token=abc", "TOKEN : 'abcdef'", "secret:token:abcdefgh", "pässword passWORD= x.y-z/12", 'api_key="' + hexes(40) + '"', "é日😀 token = " + hexes(30) + " apikey:" + base62(9),
             "AKIA" + "Q" * 15, "AKIA" + "Q7" * 9 + "x", "AKIAAKIA" + "B" * 20, hexes(23), hexes(24) + "g" + hexes(64), "ab " * 20000 + hexes(32), "token=" * 300, "x" + base62(40), base62(60) + " " + base62(33)]
    texts += ["see " + base62(40) + " end" for _ in range(40)] + ["in " + "-".join(rng.choice(("release", "version2", "build", "final", "0001", "img")) for _ in range(6)) for _ in range(40)]
    return texts + texts[:6]


def test_secrets_match_brute_force(spark):
    texts = secret_rows()
    df = spark.createDataFrame([(i, t, "k", 5, "o") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [want.count(k) for k in ("assign", "access", "hex")]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == [s for s in want.split(",") if s]
    assert sum(got[i].n_random for i, t in enumerate(texts) if (t or "").startswith("see ")) >= 37
    assert sum(got[i].n_random for i, t in enumerate(texts) if (t or "").startswith("in ")) == 0
    assert secrets.digest(df.limit(0)).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh1234567890abcdef99 é b", "k", 1, "o"), (2, None, "k", 1, "o"), (3, "clean\n text", "k", 1, "o")], DOCS)
    got = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert got[1].text == "a [secret] é b" and got[2].text is None and got[3].text == "clean\n text" and got[1].out == "o"


def brute_battery(token):
    """The battery in plain Python, with exact normal and binomial tails."""
    name, _, letters = next(e for e in secrets.ENCODINGS if re.match(e[1], token))
    folded = token.lower() if name in ("hex", "base36") else token
    x, k, n = [letters.index(c) for c in folded], len(letters), len(token)
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    if n >= secrets.FULL * k:
        chi2, df = sum(folded.count(c) ** 2 for c in letters) * k / n - n, k - 1
    else:
        cells = [[c for c in letters if f(c)] for f in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: not c.isalpha())]
        cells = [(sum(folded.count(c) for c in x), n * len(x) / k) for x in cells if x]
        chi2, df = sum((o - e) ** 2 / e for o, e in cells), len(cells) - 1
    chi = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [c >= k / 2 for c in x]
    n1, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    both = 2 * n1 * (n - n1)
    z_runs = abs(runs - both / n - 1) / math.sqrt(both * (both - n) / (n * n * (n - 1))) if both > n else 8.0
    mean = sum(x) / n
    spread = sum((c - mean) ** 2 for c in x)
    z_serial = abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / spread + 1 / n) * math.sqrt(n) if spread else 8.0
    half = -sum(math.log(max(1e-14, t)) for t in (upper(chi),)) - sum(math.log(min(1, 2 * max(1e-14, upper(z)))) for z in (z_runs, z_serial))
    p = math.exp(-half) * (1 + half + half * half / 2)
    words = re.sub("[^A-Za-z0-9]", "", token)
    kind = lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l"
    changes = sum(a != b and a + b != "ul" for a, b in zip(map(kind, words), map(kind, words[1:])))
    rare = sum(c in "jkqvwxyzJKQVWXYZ" for c in words)
    tail = lambda n, k, q: sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k, n + 1)) if k > 0 else 1.0
    a, b = tail(len(words) - 1, changes, secrets.CHANGES), tail(sum(map(str.isalpha, words)), rare, secrets.RARE)
    return name, chi, z_runs, z_serial, p, changes, rare, a if name == "hex" else min(1, a * b * (1 - math.log(a * b)))


ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base62": string.digits + string.ascii_letters, "base64": string.digits + string.ascii_letters + "+/", "base64url": string.digits + string.ascii_letters + "-_"}


def random_token(rng, name, n):
    while True:
        t = "".join(rng.choice(ALPHABETS[name]) for _ in range(n))
        if re.search("[0-9]", t) and re.search("[A-Za-z]", t):
            return t


def ordinary_tokens(rng):
    """Identifiers, slugs, paths, versions, UUIDs and camel case, each with letters and digits and 20 characters or more."""
    w = lambda: rng.choice("service user account deployment kubernetes cluster image build final release report backup index table server config house river window people thing order value handler factory module version market quick weekly january project query proxy job".split())
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = [
        lambda: "-".join([w(), w(), w(), d(4)]), lambda: "_".join([w(), w(), w(), w(), d(2)]), lambda: "/".join([w(), w(), d(4), d(2), d(2), w()]),
        lambda: w() + "".join(x.capitalize() for x in (w(), w(), w())) + d(2), lambda: "-".join((h(8), h(4), h(4), h(4), h(12))), lambda: w() + w() + w() + d(8),
        lambda: (w() + "_" + w() + "_" + w()).upper() + "_V" + d(1), lambda: "-".join([w(), w(), "7d9f8b6c5", rng.choice(("x2vqz", "k8s1p", "abcd1"))]), lambda: w() + d(4) + w() + d(4) + w(), lambda: w() + "-v" + d(1) + "-" + d(2) + "-" + d(1) + "-" + w(),
    ]
    return lambda: next(t for t in (rng.choice(made)() for _ in iter(int, 1)) if len(t) >= 20 and re.search("[0-9]", t) and re.search("[A-Za-z]", t))


def test_battery_against_plain_python(spark):
    rng = random.Random(8)
    make = ordinary_tokens(rng)
    tokens = [random_token(rng, name, n) for name in ALPHABETS for n in (20, 21, 32, 47, 100, 500)] + [make() for _ in range(60)]
    tokens += ["a" * 19 + "1", "1" * 30 + "a", "ab1" * 10, "A1" * 12, "----------------a1---", "deadbeef" * 4, "Zz9" * 100]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b"))
    for r in df.collect():
        want = brute_battery(r.t)
        got = (r.b.encoding, r.b.chi, r.b.runs, r.b.serial, r.b.p, r.b.changes, r.b.rare, r.b.ordinary)
        assert (got[0], got[5], got[6]) == (want[0], want[5], want[6]), r.t
        for a, b in zip(got[1:4], want[1:4]):
            assert a == pytest.approx(b, abs=1e-6), r.t
        assert got[4] == pytest.approx(want[4], abs=1e-5) and got[7] == pytest.approx(want[7], rel=1e-6, abs=1e-12), r.t


def test_thresholds_are_benjamini_hochberg(spark):
    rng = random.Random(9)
    tokens = [(rng.choice(("a:4", "b:5")), rng.choice((0, 0, 0, rng.randrange(secrets.BINS)))) for _ in range(300)]
    df = spark.createDataFrame([([(0, 1, s, b)],) for s, b in tokens], "tokens array<struct<start:int,end:int,stratum:string,bin:int>>")
    for rate in (0.01, 0.05, 0.3):
        want = {}
        for s in ("a:4", "b:5"):
            bins = sorted((b for t, b in tokens if t == s), reverse=True)
            passed = [b for i, b in enumerate(bins) if math.exp(-b * 32 / secrets.BINS) <= rate * sum(x >= b for x in bins) / len(bins)]
            if passed:
                want[s] = min(passed)
        assert secrets.thresholds(df, rate) == want


def test_planted_tokens_among_ordinary_ones(spark):
    """Precision and recall by encoding and length, as the README states them; as many ordinary strings as random ones."""
    rng = random.Random(10)
    make = ordinary_tokens(rng)
    planted = [(name, n, random_token(rng, name, n)) for name in ALPHABETS if name != "hex" for n in (20, 24, 32, 40, 64) for _ in range(60)]
    rows = planted + [("ordinary", 0, make()) for _ in range(len(planted))]
    df = spark.createDataFrame([(i, "see " + t + " there", "k", 5, "o") for i, (_, _, t) in enumerate(rows)], DOCS)
    hit = {r.doc_id: r.n_random for r in secrets.digest(df).collect()}
    recall = {}
    for i, (name, n, _) in enumerate(rows):
        recall.setdefault((name, n), []).append(hit[i])
    recall = {k: sum(v) / len(v) for k, v in recall.items()}
    print(recall)
    false = sum(hit[i] for i, r in enumerate(rows) if r[0] == "ordinary")
    print(false, sum(hit.values()), [r[2] for i, r in enumerate(rows) if r[0] == "ordinary" and hit[i]][:9])
    assert false <= 0.05 * sum(hit.values())
    assert all(recall[name, n] >= 0.8 for name in ("base62", "base64", "base64url") for n in (32, 40, 64)) and all(recall[name, 64] >= 0.8 for name in ("base32", "base36"))


def test_long_texts_and_runs(spark):
    rng = random.Random(11)
    run = random_token(rng, "base64", 100_000)
    many = " ".join(random_token(rng, "base62", 40) for _ in range(3000))
    df = spark.createDataFrame([(1, run, "k", 5, "o"), (2, many, "k", 5, "o"), (3, "token=abcdef " * 3000, "k", 5, "o")], DOCS)
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    assert got[1].spans == "random:0:100000" and got[2].n_random >= 2900 and got[3].n_assign == 3000
    assert got[3].spans.split(",")[-1] == f"assign:{13 * 2999}:{13 * 3000 - 1}"


def test_columns_of_the_same_names_stay(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh é", 1, 2, 3, 4, 5, 6, 7)], "doc_id long, text string, base int, spans int, spans_ int, row int, tokens int, m_hex int, runs int")
    got = secrets.scan(df)
    assert got.columns == [*df.columns, "base_", "spans__"] and got.select(*df.columns).collect() == df.collect()
    out = secrets.redacted(df)
    assert out.columns == df.columns and out.first()[1:] == ("a [secret] é", 1, 2, 3, 4, 5, 6, 7)


def brute_mix(rows, weights, max_epochs, seed, budget=None):
    leaves = {}
    for i, (doc, n, *path) in enumerate(rows):
        leaves.setdefault(tuple(p or "" for p in path), []).append((doc, n))
    cap = {k: max_epochs * sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(n for r in leaves.values() for _, n in r) if budget is None else budget

    def flow(prefix, given, out):
        depth = len(prefix)
        if depth == 3:
            out[prefix] = given
            return
        kids = sorted({k[: depth + 1] for k in cap if k[:depth] == prefix})
        caps = {k: sum(c for q, c in cap.items() if q[: depth + 1] == k) for k in kids}
        w = {k: weights[depth].get(k[-1], 1) for k in kids}
        left, open_, share = given, set(kids), {}
        while True:
            full = [k for k in open_ if caps[k] * sum(w[q] for q in open_) <= w[k] * max(left, 0)]
            if not full:
                break
            k = min(full, key=lambda k: (caps[k] / w[k], k))
            share[k] = caps[k]
            left -= caps[k]
            open_.discard(k)
        for k in open_:
            share[k] = left * w[k] // sum(w[q] for q in open_)
        for k in kids:
            flow(k, share[k], out)

    out = {}
    flow((), min(total, sum(cap.values())), out)
    result = []
    for leaf, given in out.items():
        have = sum(n for _, n in leaves[leaf])
        full, rest = divmod(given, have) if have else (0, 0)
        for e in range(full):
            result += [(d, n, e) for d, n in leaves[leaf]]
        used = 0
        for d, n in sorted(leaves[leaf], key=lambda x: hashlib.md5(f"{seed}:{full}:{'null' if x[0] is None else x[0]}".encode()).hexdigest()):
            used += n
            if used > rest or rest <= 0:
                break
            result.append((d, n, full))
    return sorted(result, key=str), out


@pytest.mark.parametrize("budget", [None, 100, 10**9])
def test_mix_matches_brute_force(spark, budget):
    rng = random.Random(8)
    rows = [(i, rng.randrange(0, 60), rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice(["s", "s", "s", "t", "u"])) for i in range(400)] + [(1000 + i, 9, "d", "x", "hot") for i in range(200)]
    weights = ({"a": 9, "b": 2}, {"x": 3}, {"t": 5})
    df = spark.createDataFrame(rows, "doc_id long, n long, p string, q string, r string").withColumn("text", F.lit(None).cast("string")).withColumn("weight", F.lit(1))
    out = mixing.mix(df, {"p": F.col("p"), "q": F.col("q"), "r": F.col("r")}, weights, budget=budget, tokens=F.col("n"))
    want, given = brute_mix(rows, weights, 4, 1, budget)
    assert sorted(((r.doc_id, r.n, r.epoch) for r in out.collect()), key=str) == want
    assert out.limit(0).collect() == [] and mixing.mix(df.limit(0), {"p": F.col("p")}, ({},), tokens=F.col("n")).collect() == []


@pytest.mark.parametrize("budget", [None, 0, 5, 10**9])
def test_leaf_without_tokens_is_taken_once(spark, budget):
    rows = [(1, None, None), (2, None, None), (3, " ", None), (4, "a b c", "s"), (5, "d e", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, r string")
    out = mixing.mix(df, {"r": F.col("r")}, ({},), budget=budget).collect()
    assert sorted((r.doc_id, r.epoch) for r in out if r.doc_id < 4) == [(1, 0), (2, 0), (3, 0)]
    assert sum(r.n_tokens for r in out) == min(20, 5 if budget is None else budget)


CHATS = "conv_id long, turn long, role string, text string, t int, m string"


def brute_chat(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        listed = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["###", "####", "</turn>", "</part>", "\\", "\\h", "\\t", "\\b", "### user: ", "\n", "é", "x", ": ", "</turn>\n", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "Odd: Role"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))]), 1, "z") for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, None, "user", "a", 1, "z"), (None, 0, "user", "a", 1, "z"), (99, 3, "assistant", "same", 1, "z"), (99, 3, "assistant", "same", 1, "z"), (98, 0, "assistant", "long " * 30000, 1, "z")]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said, 1, "z"), (-7, 1, "assistant", said, 1, "z")]
    df = spark.createDataFrame(rows, CHATS)
    formatted = chat.format_chats(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(chat.parse_chats(formatted)).collect()}
    assert got == brute_chat(rows)
    own = formatted.where("conv_id = -7").first().formatted
    assert own == "### user: \\b\\h Assistant: \\t ok</turn>\n### assistant: \\b\\h Assistant: \\t ok</turn>\n"
    assert formatted.where("conv_id = 99").first().formatted == "### assistant: same</part>same</turn>\n"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_mixing_keeps_columns_of_the_same_names_and_repeated_rows(spark):
    names = ["epoch", "domain", "n_tokens", "level0", "c0", "tokens", "id", "tie", "full", "rest", "order", "bucket", "_full"]
    rows = [(i // 2, "one two three", None if i % 3 else "src1", *range(len(names))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mix(df, {"domain": F.col("source")}, ({},), max_epochs=2)
    assert out.columns == [*df.columns, "domain_", "n_tokens_", "epoch_"]
    got = out.collect()
    assert {tuple(r)[: len(df.columns)] for r in got} <= set(rows)
    assert sorted(r.domain_ for r in got) == [""] * 6 + ["src1"] * 6 and {r.n_tokens_ for r in got} == {3}  # half of 36 tokens for each leaf
    assert sorted(r.epoch_ for r in got if r.domain_) == [0] * 4 + [1] * 2


def test_chat_matches_its_sql(spark, sf_dir):
    from lodestone.llm import queries
    from oracle import connect, difference

    assert difference(queries.op6_chat(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op6_chat"]) == ""

"""Secret scans: the battery on random and natural strings, and the whole scan."""

import base64
import random

import numpy as np
import pytest
from llm_fixtures import CLASHING, prose

from meridian.llm import secrets as sc

rng = random.Random(7)
PLANTED = {
    "hex": ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)],
    "base64": [base64.b64encode(rng.randbytes(48)).decode() for _ in range(12)],
    "alnum": ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(12)],
}


def test_infer_takes_the_smallest_alphabet():
    assert sc.infer(b"0123456789012345")[0] == "decimal"
    assert sc.infer(b"DEADBEEF" * 4) == ("hex", b"deadbeef" * 4)
    assert sc.infer(b"abcdefghijklmnopqrst")[0] == "lower" and sc.infer(b"abcdefghijklmnopqrst1")[0] == "lower36"
    assert sc.infer(b"ABCDEFGHIJKLMNOP2345")[0] == "base32" and sc.infer(b"aB3/aB3+aB3/aB3+aB==")[0] == "base64" and sc.infer(b"aB3-aB3_aB3-aB3_aB3x")[0] == "base64url"
    assert sc.infer(b"1234-5678-9012-3456")[0] == "decimal" and sc.infer(b"a" * 10 + b"=" * 10) is None


@pytest.mark.parametrize("name", ["hex", "base32", "alnum", "base64"])
def test_p_values_are_about_uniform_on_random_strings(name):
    g = np.random.default_rng(1)
    size = len(sc.ALPHABETS[name])
    for p in sc.battery(g.integers(0, size, (4000, 64)), size):
        assert abs((p < 0.1).mean() - 0.1) < 0.05 and abs((p < 0.5).mean() - 0.5) < 0.1


def test_battery_sees_each_departure():
    n = 96
    constant, alternating, slope = np.zeros((1, n), int), np.tile([0, 15], n // 2)[None], np.repeat(np.arange(16), 6)[None]
    assert sc.battery(constant, 16)[0][0] < 1e-6
    assert sc.battery(alternating, 16)[1][0] < 1e-6 and sc.battery(slope, 16)[2][0] < 1e-6 and sc.battery(slope, 16)[0][0] > 0.9


@pytest.fixture(scope="module")
def rows():
    out, k = [], 0
    for i in range(150):
        text = prose(i, 80) + " " + "".join(prose(i + 9000, 6).split()) + " " + str(10**17 + i * 7919)
        out.append((i, text))
    for name, runs in PLANTED.items():
        for run in runs:
            out.append((1000 + k, prose(k, 20) + f' token="{run}" ' + prose(k + 1, 20)))
            k += 1
    return out


def test_planted_secrets_are_found_and_natural_runs_left(docs_of, rows):
    got = sc.scan(docs_of(rows)).toPandas()
    found = set(got[got.secret].doc_id)
    planted = {i for i, _ in rows if i >= 1000}
    assert len(found & planted) >= 0.9 * len(planted) and len(found - planted) <= 1
    assert (got[got.encoding == "decimal"].secret == False).all()  # noqa: E712


@pytest.mark.parametrize("name", list(PLANTED))
def test_values_after_equals_signs_are_candidates(name):
    run = PLANTED[name][0].encode()
    for text in (b"API_KEY=%s", b"password=%s\n", b"https://a.example/x?token=%s&y=1", b"AWS_SECRET_ACCESS_KEY=%s", b"a=b==%s", b"=%s", b"%s=next"):
        found = {r: start for start, r, *_ in sc.candidates((text % run).decode())}
        assert found[run] == (text % run).index(run), text
    padded = base64.b64encode(bytes(range(40)))
    assert padded.endswith(b"==") and [r for _, r, *_ in sc.candidates("key=" + padded.decode())] == [padded]


def test_only_letters_of_the_word_hide_a_run():
    run = PLANTED["hex"][0]
    for left, right in ("：；", "“”", "‘’", "—–", "«»", "钥匙", "はで", "는를", "\ufeff\u00a0", "🔑🔑", "№²"):
        assert [r for _, r, *_ in sc.candidates(f"{left}{run}{right}")] == [run.encode()], left
    for text in ("é" + run, run + "ß", "e\u0301" + run, run + "\u0301", "٣" + run, run + "ｱ"):
        assert bool(list(sc.candidates(text))) == text.endswith("ｱ"), text


def test_offsets_and_digests(docs_of):
    import hashlib

    run = PLANTED["hex"][0]
    text = "é漢 token " + run + " end"
    r = sc.scan(docs_of([(1, text)])).first()
    assert text.encode()[r["start"] : r["start"] + r["length"]] == run.encode() and r["digest"] == hashlib.sha256(run.encode()).hexdigest()[:16]


def test_control_equals_benjamini_hochberg(docs_of, rows):
    got = sc.scan(docs_of(rows)).toPandas()
    got["stratum"] = [sc.stratum(n) for n in got.length]
    for (name, _), g in got[(got.encoding == "hex") | (got.encoding == "lower")].groupby(["encoding", "stratum"]):
        p = np.sort(g.natural.to_numpy())
        ok = np.flatnonzero(p <= sc.FALSE_DISCOVERIES * np.arange(1, p.size + 1) / p.size)
        limit = p[ok[-1]] if ok.size else -1
        assert ((g.natural <= limit) == g.secret).all(), name


def _runs(n, seed, length=64):
    g = random.Random(seed)
    return ["".join(g.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(length)) for _ in range(n)]


def identifiers(kind, n, longest=10**6):
    """Names as programs have them: camelCase, snake and kebab case, paths, words with digits."""
    out = []
    for i in range(n):
        g, found = random.Random(i * 31 + len(kind)), prose(i, random.Random(i).randint(4, 9)).split()
        year = str(g.randrange(1990, 2030)) if g.random() < 0.3 else ""
        out.append({
            "camel": found[0] + "".join(w.capitalize() for w in found[1:]) + year,
            "pascal": "".join(w.upper() if g.random() < 0.1 else w.capitalize() for w in found) + year,
            "snake": g.choice("_-").join(w.capitalize() if g.random() < 0.2 else w for w in found) + "X" + year,
            "path": "/".join(w.capitalize() if g.random() < 0.3 else w for w in found) + year,
            "lower36": "".join(found) + str(g.randrange(10**3)),
            "long": "".join(found).capitalize() + str(g.randrange(10)),
        }[kind][:longest])
    return [x for x in out if len(x) >= 16]


@pytest.mark.parametrize("kind", ["camel", "pascal", "snake", "path", "lower36", "long"])
def test_identifiers_are_left_and_a_key_among_them_is_found(docs_of, kind):
    names = identifiers(kind, 1000)
    lines = [prose(i, 30) + " " + " ".join(names[i : i + 10]) for i in range(0, len(names), 10)]
    key = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=64)) if kind == "lower36" else _runs(1, 4)[0]
    if kind in ("snake", "path"):
        key = key[:30] + {"snake": "-", "path": "/"}[kind] + key[31:]
    got = sc.scan(docs_of([*enumerate(lines), (5000, "a " + key + " b")])).toPandas()
    assert len(got) >= 900 and got[got.doc_id < 5000].secret.sum() <= 0.02 * len(got)
    assert got[got.doc_id == 5000].secret.all()


def test_rare_secrets_are_found_however_many_natural_runs_there_are(docs_of):
    """One key in ten thousand candidates of its stratum and encoding."""
    natural, keys = [a + b[0].upper() + b[1:] for a, b in zip(identifiers("camel", 20_000), identifiers("camel", 40_000)[20_000:])], _runs(20, 3, 86)
    natural = [x for x in natural if sc.stratum(len(x)) == 80]
    natural = (natural * (200_000 // len(natural) + 1))[:200_000]
    lines = [" ".join(natural[i : i + 500]) for i in range(0, len(natural), 500)]
    got = sc.scan(docs_of([*enumerate(lines), *((5000 + i, f"{k} end") for i, k in enumerate(keys))])).toPandas()
    got = got[(got.encoding == "alnum") & (got.length >= 80)]
    assert len(got) > 150_000
    found = got[got.secret].doc_id
    assert (found >= 5000).sum() >= 19 and (found < 5000).sum() <= 1


def _upper_gamma(a, x):
    """Regularised upper incomplete gamma function, by its series."""
    import math

    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return 1 - total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 1.0


def _plain(symbols, size):
    """The battery's three p-values by the textbook, one symbol at a time."""
    import math

    n = len(symbols)
    bins = max(2, min(size, n // 4))
    share = [0] * bins
    for k in range(size):
        share[k * bins // size] += n / size
    seen = [0] * bins
    for s in symbols:
        seen[s * bins // size] += 1
    uniform = _upper_gamma((bins - 1) / 2, sum((o - e) ** 2 / e for o, e in zip(seen, share)) / 2)
    high = [s >= size / 2 for s in symbols]
    above, runs = sum(high), 1 + sum(x != y for x, y in zip(high, high[1:]))
    if above in (0, n):
        run = 2.0 ** (1 - n)
    else:
        mean = 1 + 2 * above * (n - above) / n
        run = math.erfc(abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)) / math.sqrt(2))
    centre = sum(symbols) / n
    power = sum((s - centre) ** 2 for s in symbols)
    r = sum((x - centre) * (y - centre) for x, y in zip(symbols, symbols[1:])) / power if power else 0
    serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2)) if power else 0.0
    return uniform, run, serial


def test_all_p_values_and_verdicts_by_brute_force(docs_of, rows):
    """Battery, share of simulated strings, fitted tail and control, recomputed a candidate at a time."""
    import math

    table = {}
    for i, text in rows:
        for start, run, name, body in sc.candidates(text):
            table[i, start] = (name, len(body), [sc.ALPHABETS[name].index(c) for c in body])
    pairs = np.zeros((26, 26), int)
    for _, text in rows:
        low = text.lower()
        for a, b in zip(low, low[1:]):
            if "a" <= a <= "z" and "a" <= b <= "z":
                pairs[ord(a) - 97, ord(b) - 97] += 1
    simulated = sc.simulate(pairs)
    got = sc.scan(docs_of(rows)).toPandas()
    assert len(got) == len(table)
    want, learnt = {}, got.groupby(["encoding", got.doc_id * 0 + [sc.stratum(table[d, s][1]) for d, s in zip(got.doc_id, got.start)]]).size()
    for r in got.itertuples():
        name, n, symbols = table[r.doc_id, r.start]
        for p, q in zip((r.uniform, r.runs, r.serial), _plain(symbols, len(sc.ALPHABETS[name]))):
            assert abs(p - q) < 3e-3 or abs(math.log(max(p, 1e-12)) - math.log(max(q, 1e-12))) < 0.2
        if learnt[name, sc.stratum(n)] >= 100 or name == "decimal":
            continue
        x = max(sc.MEDIAN, -2 * sum(math.log(max(p, 1e-16)) for p in (r.uniform, r.runs, r.serial)))
        null = sorted(simulated[name][sc.stratum(n)])
        k = int(sc.TAIL * len(null))
        if x >= null[k - 1]:
            p = (sum(v <= x for v in null) + 1) / (len(null) + 1)
        else:  # the most likely power of a share (x / u) ** a
            a = min(sc.STEEPEST, k / sum(math.log(null[k - 1] / max(v, 1e-9)) for v in null[:k]))
            p = k / (len(null) + 1) * (x / null[k - 1]) ** a
        assert abs(math.log10(r.natural) - max(-30, math.log10(p))) < 0.02, (name, n)
        want.setdefault((name, sc.stratum(n)), []).append((r.natural, r.secret))
    assert len(want) >= 3
    for verdicts in want.values():
        verdicts.sort()
        limit = max([p for k, (p, _) in enumerate(verdicts) if p <= sc.FALSE_DISCOVERIES * (k + 1) / len(verdicts)], default=-1)
        assert all(secret == (p <= limit) for p, secret in verdicts)


def test_share_of_natural_strings_learns_from_the_corpus():
    g = np.random.default_rng(5)
    far = sc.Shares(g.normal(120, 10, 5000))
    bins = 900
    count = lambda x: np.bincount((x / sc.WIDTH).astype(int), minlength=bins)[:bins]
    assert far(6.0) < 1e-12 and far(0.0) == far(sc.MEDIAN)
    only_keys = sc.Shares(g.normal(120, 10, 5000))
    only_keys.learn(count(g.chisquare(6, 100_000)))
    assert only_keys(6.0) < 1e-12
    mixed = sc.Shares(g.normal(120, 10, 5000))
    mixed.learn(count(np.r_[g.chisquare(6, 100_000), g.normal(90, 12, 2000).clip(30)]))
    assert mixed(6.0) < 1e-5
    near = sc.Shares(g.normal(120, 10, 5000))  # the corpus's natural runs look more random than the simulated ones
    near.learn(count(g.gamma(4, 8, 100_000)))
    assert near(6.0) > 1e-3 and near(6.0) > 1e3 * far(6.0)


def test_awkward_rows(docs_of, awkward):
    long = "x" * 50 + " " + PLANTED["hex"][1] + " " + "ab" * 40_000
    rows = [*awkward, (30, long), (None, PLANTED["hex"][2]), (31, PLANTED["hex"][3]), (31, PLANTED["hex"][3]), (32, "é" + PLANTED["hex"][4])]
    got = sc.scan(docs_of(rows, **CLASHING)).collect()
    ids = [r["doc_id"] for r in got]
    assert ids.count(31) == 2 and ids.count(None) == 1 and 32 not in ids and ids.count(30) == 3
    assert max(r["length"] for r in got) == 80_000


def test_empty_table(docs_of):
    assert sc.scan(docs_of([(1, "a")]).where("false")).count() == 0


def test_ids_of_any_type(docs_of):
    from pyspark.sql import functions as F

    df = docs_of([(1, PLANTED["hex"][0] + " x"), (2, "none")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert [r["doc_id"] for r in sc.scan(df).collect()] == ["d1"]

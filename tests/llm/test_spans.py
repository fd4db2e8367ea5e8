"""Personal data and secrets against Python's own matcher; the labelers' EM and the randomness battery."""

import hashlib
import random
import re

import pytest

from leafmill.llm import pii, secrets

SCHEMA = "doc_id long, text string, row int, kind string, start long, pieces string, base boolean, p double"


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "k", 2, None, True, 0.5) for i, t in texts], SCHEMA).repartition(3)


def personal(text):
    out = []
    text = text or ""
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def secret(text):
    out = []
    text = text or ""
    pattern = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def noisy(seed, parts):
    rng = random.Random(seed)
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))


PERSONAL_PARTS = [
    "a.b", "@", "mail", ".com", "_", " ", "é", "𝒳", "1.2.3.4", ".", "255", "256", "0012", "+", "1 ", "(555) ", "555-1234", "4111 1111 1111 1111",
    "4111111111111112", "-", "79927398713", "\n", "x@y", "@z.org", "+1 (212) 555-0147",
]
SECRET_PARTS = ["token", "PassWord", "api_key", "apikey", " = ", ":", "=", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", " ", "é", "\n", "/", "token:token:abcdef"]


@pytest.mark.parametrize(
    ("find", "brute", "parts", "module"), [(pii.personal_data, personal, PERSONAL_PARTS, pii), (secrets.secret_spans, secret, SECRET_PARTS, secrets)]
)
def test_base_spans(spark, find, brute, parts, module):
    texts = [(i, noisy(i, parts)) for i in range(250)] + [(1000, None), (1001, ""), (None, parts[0]), (5, "again"), (1002, "a@b" + ".c" * 30_000), (1003, "7" * 60_000), (1004, "ab" * 60_000)]
    found, spans = find(table(spark, texts))
    out = pii.per_document(found, spans, module.KINDS, module.BASE).collect()
    assert len(out) == len(texts)
    expected = []
    for i, t in texts:
        told = ",".join(f"{module.BASE[k]}:{a}:{b}" for a, k, b in brute(t))
        expected.append((str(i), *[sum(k == j for _, k, _ in brute(t)) for j in range(len(module.BASE))], hashlib.sha256(told.encode()).hexdigest()))
        for r in out:
            if r["doc_id"] == i and i is not None and sum(j == i for j, _ in texts) == 1:
                assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
    assert sorted((str(r["doc_id"]), *[r[f"n_{k}"] for k in module.BASE], r["base_sha256"]) for r in out) == sorted(expected)


@pytest.mark.parametrize("find", [pii.personal_data, secrets.secret_spans])
def test_empty_tables(spark, find):
    found, spans = find(table(spark, []))
    assert found.count() == 0 and spans.count() == 0


def test_wider_spans_are_found_and_decoys_left(spark):
    texts = [(i, f"please call (212) 555-{1000 + i} or write to jane{i} [at] site [dot] org now") for i in range(30)]
    texts += [(100 + i, f"order 123-45-{6000 + i}x and build 1.2.{i}") for i in range(30)]
    _, spans = pii.personal_data(table(spark, texts))
    kinds = {}
    for r in spans.collect():
        kinds.setdefault(r["kind"], []).append(r["value"])
    assert len(kinds["local_phone"]) == 30 and len(kinds["masked_email"]) == 30
    assert set(kinds) == {"local_phone", "masked_email"}


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int(body + "131400") % 97  # DE
    return f"DE{check:02d}{body}"


def test_domains_outside_the_list_national_and_account_numbers(spark):
    rng = random.Random(7)
    wanted, texts = {}, []
    for i in range(40):
        top = rng.choice(["pl", "ca", "com.au", "jp", "org", "de"])
        masked = f"jane{i} [at] firma{i} [dot] {top}" if i % 2 else f"jane{i}(at)firma{i}.{top}"
        for kind, cue, value in (
            ("masked_email", "mail:", masked), ("national_id", "ssn:", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"), ("account", "iban", iban(rng)),
        ):
            wanted[len(texts)] = (kind, value)
            texts.append((len(texts), f"some words here, {cue} {value} and more"))
    decoys = len(texts)
    for i in range(40):
        texts.append((len(texts), f"we meet (at) noon. Then order 9{rng.randrange(10, 99)}-00-{rng.randrange(1000, 9999)}, ticket DE00{rng.randrange(10**17, 10**18)}x"))
    found, spans = pii.personal_data(table(spark, texts))
    at = {r["row"]: r["id"] for r in found.collect()}
    got = {}
    for r in spans.collect():
        got.setdefault(at[r["row"]], []).append((r["kind"], r["value"]))
    for kind in ("masked_email", "national_id", "account"):
        own = [i for i, (k, _) in wanted.items() if k == kind]
        assert sum(wanted[i] in got.get(i, []) for i in own) >= 0.9 * len(own), kind
    assert sum(i >= decoys for i in got) <= 2


def test_reliabilities_separate_agreeing_labelers():
    patterns = [("card", 1, 1, 1, 1, 80), ("card", 0, 0, -1, 1, 300), ("card", 1, 0, -1, 1, 10), ("card", 0, 1, 1, 1, 5)]
    p = pii.reliabilities(patterns)
    assert p["card", 1, 1, 1, 1] > 0.95 and p["card", 0, 0, -1, 1] < 0.05


def test_random_tokens_against_words(spark):
    rng = random.Random(1)
    alphabets = ["0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    hidden = [(i, "see " + "".join(rng.choice(alphabets[i % 2]) for _ in range(40)) + " here") for i in range(200)]
    plain = [(1000 + i, "see /usr/share/local/python3/site-packages/module" + str(i) + "/aaaaaaaaaaaaaaaaaaaaaaaaaa1 here") for i in range(200)]
    _, spans = secrets.secret_spans(table(spark, hidden + plain))
    found = [r["value"] for r in spans.where("kind = 'random'").collect()]
    true = {t.split()[1] for _, t in hidden}
    assert len(true & set(found)) >= 0.85 * len(true)
    assert sum(v not in true for v in found) <= 0.05 * len(found)


def test_random_values_behind_names_and_paths(spark):
    rng = random.Random(3)
    base62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    draw = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(40))
    made = {
        "session": ("SESSION_KEY={} and", base62), "sig": ("?id=7&sig={}&x=1", base62), "padded": ("AUTH={}== end", base62 + "+/"),
        "path": ("/srv/a+b/{}", base62 + "-_"), "letters": ("é {}.", base62[10:]),
    }
    texts, true = [], {}
    for k, (name, (form, alphabet)) in enumerate(made.items()):
        for i in range(120):
            value = draw(alphabet)
            while name == "path" and not set(value) & set("-_"):  # else all of it is base 64
                value = draw(alphabet)
            at = form.index("{}")
            texts.append((1000 * k + i, form.format(value)))
            true[1000 * k + i] = (value, at)
    docs = table(spark, texts)
    found, spans = secrets.secret_spans(docs)
    at = {r["row"]: r["id"] for r in found.collect()}
    hit = set()
    for r in spans.where("kind = 'random'").collect():
        value, start = true[at[r["row"]]]
        if r["start"] == start and r["value"].rstrip("=") == value:
            hit.add(at[r["row"]])
    for k, name in enumerate(made):
        assert sum(i // 1000 == k for i in hit) >= 0.8 * 120, name


def test_thresholds_by_stratum():
    even = [("long", b, 50) for b in range(20)] + [("long", 0, 900)]
    crowded = [("short", b, 30 - b) for b in range(20)] + [("short", 0, 50_000)]
    chosen = secrets.thresholds(even + crowded)
    assert 0 < chosen["long"] <= 0.1
    assert chosen.get("short", 1) >= 0.05


def test_copies_of_a_token_do_not_move_the_threshold(spark):
    rng = random.Random(8)
    draw = lambda: "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(40))
    hidden = spark.createDataFrame([(draw(),) for _ in range(300)], "value string")
    tested = secrets.battery(hidden).withColumn("stratum", secrets.stratum()).collect()
    middle = next(r["value"] for r in tested if 0.25 <= r["p"] < 0.45)
    texts = [(i, f"see {r['value']} here") for i, r in enumerate(tested)] + [(1000 + i, f"build {middle} here") for i in range(600)]
    _, spans = secrets.secret_spans(table(spark, texts))
    found = {r["value"] for r in spans.where("kind = 'random'").collect()}
    assert len(found) >= 0.9 * 300

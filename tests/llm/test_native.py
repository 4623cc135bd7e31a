"""PII surrogates and license scans."""

import re

import pytest

pytest.importorskip("public_tokenizers")

from hashloom.llm import licenses, pii  # noqa: E402


def test_surrogates(spark):
    texts = [
        "Mail a.b@mail.org or A.B@MAIL.ORG, call +1 (042) 555-7845 or +1 042 555 7845.",
        "Mrs Anna Schmidt met John Schmidt; Frau Schmidt paid 4111 1111 1111 1111 and 4111111111111111.",
        "г-жа Анна Петрова, DE89 3704 0044 0532 0130 00, 123-45-6789, 10.20.30.40, " + "ab12" * 10,
        None,
        "",
        "Nothing here, version 4.0 of 2024.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y")], "doc_id long, text string, kind string")
    rows = pii.pseudonymize(df, "key").collect()
    got = {r.doc_id: r for r in rows}
    assert got[3].text is None and got[4].text == "" and got[5].text == texts[5] and got[5].n_entities == 0
    assert got[None].text == got[0].text and got[None].kind == "y"
    mails = re.findall(r"[\w.]+@[\w.]+", got[0].text)
    assert len(mails) == 2 and mails[1] == mails[0].upper() and mails[0] != "a.b@mail.org" and re.fullmatch(r"\w\.\w@\w{4}\.org\W?", mails[0])
    phones = [re.sub(r"\D", "", p) for p in re.findall(r"\+1[ \d()-]+\d", got[0].text)]
    assert len(phones) == 2 and phones[0] == phones[1] != "10425557845"
    people = re.match(r"Mrs (\w+) (\w+) met (\w+) (\w+); Frau (\w+) paid", got[1].text)
    assert people and people[1] in pii.GIVEN["f", "latin"] and people[3] in pii.GIVEN["m", "latin"]
    assert people[2] == people[4] == people[5] != "Schmidt"
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", got[1].text)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    assert re.match(r"г-жа [А-Я][а-я]+ [А-Я][а-я]+, DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, \d{3}-\d\d-\d{4}, \d+\.\d+\.\d+\.\d+, [0-9a-f]{40}$", got[2].text)
    for secret in ("Schmidt", "Петрова", "3704", "123-45-6789", "10.20.30.40", "ab12ab12"):
        assert not any(secret in (r.text or "") for r in rows)
    assert pii.pseudonymize(df, "other").filter("doc_id = 0").first().text != got[0].text
    assert pii.pseudonymize(df.limit(0), "key").count() == 0


#: Texts that repeat what a pattern may repeat, as often as a megabyte holds.
HARD = ["x@" + "a." * 500_000 + "com", "x@" + "a." * 8000 + "com", "a." * 500_000 + "@b.org", "a@" * 500_000, "1." * 500_000, "+1" + " 12" * 300_000, "(111) 111-1111" * 70_000, "AB12 " * 200_000,
        "GB12" + " ABCD" * 200_000, "ab:" * 300_000, "a:b::" * 200_000, "1-" * 500_000, "4111 " * 200_000, "9" * 1_000_000, "f" * 1_000_000, "ghp_" + "a" * 1_000_000, "sk-" * 300_000,
        "Mr " + "Aa " * 300_000, "Mr A" + "a" * 1_000_000, "Anna " * 200_000, "Анна " * 200_000]


def test_no_text_is_too_hard(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(99, "Mail x@a.org")], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.text for r in pii.pseudonymize(df, "key").collect()}
    assert len(got) == len(HARD) + 1 and "x@a.org" not in got[99] and all(got.values())


def test_persons_of_many_names(spark):
    texts = ["Anna Maria Smith met Smith.", "Dr. José María García López came", "Mrs Smith, Miss Anna Maria de", "Mr Smith " + "A" + "a" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(df, "key").collect()}
    first = re.fullmatch(r"(\w+) (\w+) (\w+) met Smith\.", got[0])
    assert first and first[1] in pii.GIVEN["f", "latin"] and first[2] in pii.GIVEN["f", "latin"] and first[3] != "Smith"
    assert re.fullmatch(r"Dr\. \w+ \w+ \w+ \w+ came", got[1]) and not re.search("García|López|María", got[1])
    # One surname has one surrogate, however many names stand before it.
    assert got[2].startswith(f"Mrs {first[3]}, Miss ") and got[3].startswith(f"Mr {first[3]} Aaa")


def test_surrogates_stay_distinct(spark):
    from hashloom.llm.shared import written

    # 26 * 26 addresses of one shape: more of them than first tries can keep apart.
    mails = [f"{a}@{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghij"]
    entities = written(spark.createDataFrame([("email", m) for m in mails], "kind string, raw string"), "test")
    rows = pii.surrogates(entities, "key").collect()
    new = {r.new for r in rows}
    assert len(rows) == len(new) == len(mails) and not new & set(mails)


def test_licenses(spark):
    words = " ".join(f"w{i}" for i in range(70))
    texts = [f"{words} {t} {words}" for _, t in licenses.TEMPLATES] + [None, "", "license", f"{words} license software notice {words}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(df).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[i, name].containment >= 0.8
    assert {i for i, _ in got} == set(range(len(licenses.TEMPLATES)))
    assert licenses.miss_bound() < 1e-3
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_edited_licenses_at_every_offset(spark):
    held = lambda sh, words: len(set(sh) & set(licenses.shingles(words))) / len(set(sh))
    rows, want = [], set()
    for name, t in licenses.TEMPLATES:
        words = licenses.words_of(t)
        if len(words) < 20:
            continue
        for k in range(len(words)):
            edited = [*words[:k], "changed", *words[k + 1 :]]
            for offset in range(70, 74):
                rows.append((len(rows), " ".join([*(f"w{i}" for i in range(offset)), *edited, *(f"v{i}" for i in range(70))])))
                if held(licenses.shingles(words), edited) >= licenses.THRESHOLD:
                    want.add((rows[-1][0], name))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(df).collect()}
    assert len(want) > 400 and not want - got


def test_tokens_in_upper_case(spark):
    # The second looks like an IBAN too.
    secrets = ["9233a8ec" * 5, "de893704" * 4, "9233A8ec" * 4, "AKIA" + "Z7" * 8]
    texts = [f'TOKEN = "{s}"' for x in secrets for s in (x, x.upper())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "key").collect()}
    new = [re.fullmatch(r'TOKEN = "(\w+)"', got[i].text)[1] for i in range(len(texts))]
    assert all(got[i].n_entities == 1 and got[i].kinds == ["token"] for i in range(len(texts)))
    assert not {x.lower() for x in new} & {x.lower() for x in secrets}
    for k in range(0, 6, 2):
        assert re.fullmatch("[0-9a-f]+", new[k]) and new[k + 1] == new[k].upper() and len(new[k]) == len(secrets[k // 2])
    assert new[6] == new[7] and re.fullmatch("AKIA[A-Z][0-9A-Z]{15}", new[7])


def test_adjacent_mails(spark):
    texts = [f"Write to anna@mail.org{c}b.c@post.net{c}d@x.com now" for c in "-_%+"] + ["x anna@mail.org.b@post.net"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "key").collect()}
    assert [got[i].n_entities for i in range(5)] == [3, 3, 3, 3, 2]
    assert not any(old in r.text for r in got.values() for old in ("anna@", "b.c@", "d@x.", ".b@"))


def test_people_keep_apart_and_together(spark):
    """Against brute force: one surrogate for each surname and form, none shared."""
    given = [n for (_, script), ns in pii.GIVEN.items() if script == "latin" for n in ns]
    surnames = [f"{a}{b}son" for a in ("Bar", "Cor", "Del", "Fen", "Gor", "Hal") for b in ("an", "el", "ik", "or", "um")]
    texts = [f"Mrs {s} came" for s in surnames] + [f"{g} {s} came" for s in surnames[:4] for g in given] + [f"{given[i % 40]} {s} came" for i, s in enumerate(surnames)]
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    old = lambda t: re.fullmatch(r"(?:Mrs )?(?:(\w+) )?(\w+) came", t).groups()
    new = lambda t: re.fullmatch(r"(?:Mrs )?(?:([\w-]+) )?(\w+) came", t).groups()
    last, full = {}, {}
    for r in rows:
        (g, s), (g2, s2) = old(texts[r.doc_id]), new(r.text)
        assert last.setdefault(s, s2) == s2 and full.setdefault((g, s), (g2, s2)) == (g2, s2)
        if g:
            women = set(pii.GIVEN["f", "latin"])
            assert {x in women for x in g2.split("-")} == {g in women}
    assert len(set(last.values())) == len(last) and not set(last.values()) & set(last)
    assert len(set(full.values())) == len(full)


def test_types_stay_valid(spark):
    def luhn(n):
        d = [int(x) for x in n][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    rng = __import__("random").Random(3)
    cards = []
    while len(cards) < 40:
        n = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        cards += [n] if luhn(n) else []
    texts = cards + ["1700000000000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "10.0.0.5", "192.168.1.1", "172.20.3.4", "8.8.8.8", "a@mail.example.com", "b@mail.example.com", "+1 (042) 555-7845", "2001:db8:0:0:0:0:0:1"]
    got = {texts[r.doc_id]: r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert all(luhn(got[c]) and got[c] != c and len(got[c]) == 16 for c in cards) and len({got[c] for c in cards}) == len(set(cards))
    assert got["1700000000000"] == "1700000000000"
    for c in texts[41:43]:
        n = got[c].replace(" ", "")
        assert n[:2] == c[:2] and got[c] != c and int("".join(str(int(x, 36)) for x in n[4:] + n[:4])) % 97 == 1
    assert got["10.0.0.5"].startswith("10.") and got["192.168.1.1"].startswith("192.168.") and 16 <= int(got["172.20.3.4"].split(".")[1]) < 32
    assert 240 <= int(got["8.8.8.8"].split(".")[0]) < 255
    assert got["a@mail.example.com"].split("@")[1] == got["b@mail.example.com"].split("@")[1] != "mail.example.com"
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", got["+1 (042) 555-7845"])
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}(:[0-9a-f]){6}", got["2001:db8:0:0:0:0:0:1"])


def test_many_people_of_one_surname(spark):
    """More than a list of given names can tell apart: still names, all different."""
    texts = [f"Mrs {a}{b}{c} Barson came" for a in ("Al", "Be", "Ca", "Do") for b in ("ra", "li", "mo", "nu", "se") for c in ("na", "ta", "la", "sa", "da")]
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    new = [re.fullmatch(r"Mrs ([\w-]+) (\w+) came", r.text).groups() for r in rows]
    assert len(set(new)) == len(texts) and len({s for _, s in new}) == 1
    assert all(x in pii.GIVEN["f", "latin"] for g, _ in new for x in g.split("-"))

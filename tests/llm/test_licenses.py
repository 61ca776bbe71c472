import random
import re
from collections import defaultdict

from evidence_jobs.llm import license_scan

def test_licenses_against_a_scan(spark, empty):
    rng = random.Random(2)
    pieces = ["Under the MIT License", "apache license, VERSION 2.0", "CC-BY-NC", "under the mit", "license version 2", "cc by", "foo", "é bar", "\n", license_scan.WORDINGS[0][1]]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(80)] + [None, "", "cc by nc " * 500]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, "cc by nc", 1)], "doc_id long, text string, score int")
    got = defaultdict(list)
    for r in license_scan.scan_licenses(df).collect():
        got[r["doc_id"]].append(r)
    assert len(got[3]) == 2 and got[None][0]["n_base"] == 1
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
        places = [(p, label) for label, phrase in license_scan.BASE_PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i][0]
        at = [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(empty).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[j - 1], row[j - 1] + 1 if x == y else 0))
        row = new
    return row[-1]


def brute_labels(text):
    """Every template against every window of every document, without any k-gram."""
    words, out = license_scan.license_words(text), set()
    for t in license_scan.TEMPLATES:
        size = len(t.words)
        if t.share is None:
            out |= {t.label} if any(tuple(words[i : i + size]) == t.words for i in range(len(words))) else set()
            continue
        for i in range(0, max(1, len(words)), max(1, size // 4)):
            window = words[i : i + size + 3 + size // 2]
            if t.must <= set(window) and not t.never & set(window) and lcs(window, t.words) >= t.share * size:
                out.add(t.label)
                break
    return ",".join(sorted(out))


def test_labels_against_an_aligner(spark):
    rng = random.Random(7)
    other = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    texts = []
    for label, wording in [*license_scan.WORDINGS, *((x, y) for x, y, _, _ in license_scan.NOTICES)]:
        words = wording.split()
        changed = list(words)
        if len(words) > 20:
            for _ in range(len(words) // 12):
                changed[rng.randrange(len(changed))] = "changed"
            changed.insert(len(changed) // 2, "inserted")
        shuffled = words[:]
        rng.shuffle(shuffled)
        texts += [" ".join(other(30) + x + other(30)) for x in (words, changed, shuffled, words[: len(words) // 4])]
        texts.append(" ".join(other(5) + words + other(2000) + changed))
    texts += ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3", "licensed under the very open MIT license", "under the licensed license the", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["labels"] == brute_labels(t), t
        assert (got[i]["score"] > 0) == bool(got[i]["labels"])
    n = len(texts)
    assert [got[i]["labels"] for i in range(n - 5, n)] == ["gpl-3", "agpl-3", "mit", "", ""]
    assert all(got[5 * i + 2]["labels"] == "" for i in range(len(license_scan.WORDINGS)))  # the same words shuffled


def test_the_method_adds_labels_on_the_given_documents(spark):
    rows = license_scan.op10_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert any(r["labels"] != r["base_labels"] for r in rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "cc by nc", 1, "x")], "`doc id` long, text string, spans int, _key string")
    assert [r["labels"] for r in license_scan.scan_licenses(df, "doc id").collect()] == ["cc-by-nc"]


def test_repeated_rows_count_once(spark):
    """A wording with two of every five words replaced gets the same result in one row and in many."""
    words = dict(license_scan.WORDINGS)["mit"].split()
    changed = " ".join(f"x{i}" if i % 5 in (1, 3) else w for i, w in enumerate(words))
    texts = [changed, dict(license_scan.WORDINGS)["mit"], "under the mit license and more", "", None]
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = once
    for _ in range(6):
        many = many.unionByName(once)
    one = {tuple(r) for r in license_scan.scan_licenses(once).collect()}
    rows = [tuple(r) for r in license_scan.scan_licenses(many).collect()]
    assert set(rows) == one and len(rows) == 7 * len(texts)

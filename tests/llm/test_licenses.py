"""License scans against a plain search of all blocks."""

import random
import re

from llm_cases import SF_SMALL, edges, empty  # noqa: F401
from growthlens.llm import licenses as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(doc_id, text, templates=L.TEMPLATES, percent=90):
    ws = words(text)
    base = [(k, label) for p, label in BASE for k in range(len(ws)) if ws[k:k + len(p.split())] == p.split()]
    found = []
    for t, (_, notice) in enumerate(templates):
        known, block = words(notice), 16
        while block < 2 * len(known):
            block *= 2
        for at in range(0, len(ws), block // 2):
            shared = len(set(known) & set(ws[at:at + block]))
            if 100 * shared >= percent * len(set(known)):
                found.append((t, at, shared, shared / len(set(known))))
    labels = {label for _, label in base}
    return (doc_id, len(ws), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None),
            ",".join(sorted(labels)), ",".join(sorted(labels | {templates[t][0] for t, *_ in found})),
            1.0 if base else max((f[3] for f in found), default=0.0), [f[:3] for f in found])


def made():
    """Notices whole, broken over lines, with words missing, reversed, scattered or beside each other."""
    rnd = random.Random(6)
    out = []
    for _, notice in L.TEMPLATES:
        ws = notice.split()
        for lost in (0, 1, 2, 4):
            some = [w for k, w in enumerate(ws) if k not in rnd.sample(range(len(ws)), min(lost, len(ws)))]
            lead = [f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 200))]
            out.append(" ".join(lead) + "\n# " + "\n# ".join(some).upper() + "\n" + " ".join(lead))
        out.append(" the of a ".join(reversed(ws)))
    out += ["MIT License", "mit\nLicense mit license", "mitlicense", "MIT éLicense", "the Apache-License; GENERAL (public) license",
            "general public general public license license", "the license of the mit " * 500, "Kelvin license"]
    return out


def rows_of(scanned):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
                    [tuple(m) for m in r.matches]) for r in scanned.collect()), key=str)


def order(rows):
    return sorted(((*r[:8], sorted(r[8])) for r in rows), key=str)


def test_every_block_is_found(spark, edges):  # noqa: F811
    texts = spark.createDataFrame(list(enumerate(made())), "doc_id long, text string")
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    for docs in (edges, texts.repartition(3), small):
        want = [plain(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert order(rows_of(L.scan(docs))) == order(want)


def test_other_templates_and_thresholds(spark):
    rnd = random.Random(7)
    letters = [f"t{k}" for k in range(12)]
    templates = [(f"l{k}", " ".join(rnd.choices(letters, k=rnd.randint(1, 9)))) for k in range(8)]
    docs = spark.createDataFrame([(k, " ".join(rnd.choices(letters + ["o1", "o2"], k=rnd.randint(0, 60))))
                                  for k in range(60)], "doc_id long, text string")
    for percent in (50, 75, 100):
        want = [plain(r.doc_id, r.text, templates, percent) for r in docs.collect()]
        assert order(rows_of(L.scan(docs, templates, percent))) == order(want)


def test_no_documents(empty):  # noqa: F811
    assert L.scan(empty).collect() == []

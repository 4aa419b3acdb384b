"""Entries of keyed state: few calls whatever the page numbers and names, and the same results over many batches."""

import json
import random

import pandas as pd

from growthlens.streaming import keyed


class Entries(dict):
    def __init__(self):
        super().__init__()
        self.reads = self.writes = 0

    exists = dict.__len__

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self[key] = value

    def iterator(self):
        return iter(self.items())


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def _pages():
    pages = keyed.CompanyPages()
    pages.companies, pages.blocks = Entries(), Entries()
    return pages


def _row(p, page, version, n):
    return dict(p=p, page=page, version=version, at=0, body=json.dumps({"n_offices": n, "nz_sum": f"{n}.25"}),
                hdr=json.dumps({"name": f"{p}-{version}"}) if page == 0 else None, office=f"o{page}" if page % 3 else None)


def test_scattered_page_numbers_share_entries():
    """Page numbers far apart cost no entry each: a company of 12 pages is part of one entry."""
    pages = _pages()
    rows = [_row(f"c{c}", page, 0, 1) for c in range(200) for page in (0, *(c * 7_000 + 1_000 * k + 5 for k in range(1, 12)))]
    random.Random(1).shuffle(rows)
    out = pd.concat(pages.handleInputRows((3,), iter([pd.DataFrame(rows)]), None))
    assert len(out) == 200 and set(out["n_offices"]) == {12} and set(out["nz_sum"]) == {"15.00"}
    assert not pages.blocks and pages.companies.writes < 200 / 2 and pages.companies.reads == 0


def test_pages_over_many_batches(monkeypatch):
    """A company with many pages among small ones, pages sent again, some older: each batch gives the companies it
    touches as all pages so far do, and an entry stays small."""
    monkeypatch.setattr(keyed, "CHUNK", 50)
    monkeypatch.setattr(keyed, "PARSED", 7)
    rnd, pages, latest = random.Random(6), _pages(), {}
    for _batch in range(6):
        sent = [_row(rnd.choice(["hot", "hot", f"c{rnd.randint(0, 40)}"]), rnd.choice([0, rnd.randint(1, 10**9), rnd.randint(1, 90)]),
                     rnd.randint(0, 5), rnd.randint(1, 9)) for _ in range(180)]
        for r in sent:
            row = tuple(r[c] for c in ("version", "at", "body", "hdr", "office"))
            of = latest.setdefault(r["p"], {})
            of[r["page"]] = max(of.get(r["page"], row), row, key=keyed._rank)
        got = list(pages.handleInputRows((7,), iter([pd.DataFrame(sent[:100]), pd.DataFrame(sent[100:])]), None))
        out = {r.p: r for frame in got for r in frame.itertuples()}
        touched = {r["p"] for r in sent}
        assert set(out) == {p for p in touched if 0 in latest[p]} and sum(map(len, got)) == len(out)
        for p, r in out.items():
            n = sum(json.loads(row[2])["n_offices"] for row in latest[p].values())
            placed = [page for page, row in latest[p].items() if row[4]]
            assert float(r.nz_sum) == n + len(latest[p]) * 0.25 and r.hdr == latest[p][0][3]
            assert r.last_office == (f"o{max(placed)}" if placed else None)
    assert len(latest["hot"]) > 9 * keyed.PAGES_AN_ENTRY
    assert max(len(json.loads(v[0])) for v in pages.blocks.values()) <= 3 * keyed.PAGES_AN_ENTRY
    held = [json.loads(v[0]) for (slot,), v in pages.companies.items() if slot >= 0]
    assert sorted(p for some in held for p in some) == sorted(latest) and max(map(len, held)) <= 4 * keyed.COMPANIES_AN_ENTRY


def test_scores_share_entries(monkeypatch):
    """Scores that rise, fall, go null and come late: the best k of the latest ones, with fewer calls than scores."""
    for chunk in (65536, 64):
        monkeypatch.setattr(keyed, "CHUNK", chunk)
        rnd, top, latest = random.Random(9), keyed.SlottedTop(4), {}
        top.scores, top.top = Entries(), Value()
        for batch in range(5):
            sent = [(f"p{rnd.randint(0, 700)}", rnd.choice([None, float(rnd.randint(-9, 9)), rnd.random() * 10]),
                     rnd.choice([batch, batch, batch - 1])) for _ in range(900)]
            sent = list({(p, seq): (p, s, seq) for p, s, seq in sent if latest.get(p, (-9,))[0] != seq}.values())
            for p, s, seq in sorted(sent, key=lambda r: r[2]):
                if p not in latest or seq > latest[p][0]:
                    latest[p] = seq, s
            frame = pd.DataFrame(sent, columns=["p", "s", "seq"])
            frame["none"] = [s is None for _p, s, _seq in sent]
            out = pd.concat(top.handleInputRows(("c", 2), iter([frame[:333], frame[333:]]), None))
            want = sorted(((p, s) for p, (_seq, s) in latest.items()), key=lambda e: keyed._order(*e))[:4]
            assert list(zip(out["p"], out["s"])) == want and list(out["rank"]) == [1, 2, 3, 4]
            if chunk > 900:
                assert top.scores.writes <= (batch + 1) * 20
        assert sum(len(json.loads(held)) for _, (held,) in top.scores.items()) == len(latest) == top.top.get()[1]


def test_slots_grow_one_by_one():
    """Every row is found in its slot after each step."""
    names, table = [str(i * 37) for i in range(400)], {0: {str(i * 37): i for i in range(400)}}
    for slots in range(1, 60):
        keyed._grow(slots, slots + 1, lambda at: dict(table.get(at, {})), table.__setitem__)
        assert all(name in table[keyed._slot(name, slots + 1)] for name in names)
        assert sum(map(len, table.values())) == 400

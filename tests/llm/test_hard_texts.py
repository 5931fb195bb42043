"""Texts on which quadratic work would show: very many notices, and one run over and over."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from dialoom.llm import common, decontaminate, extract, licenses, linedup


def test_thousands_of_notices_in_one_text():
    own = licenses.Templates(licenses.LICENSES)
    codes = licenses._Coded(pa.array(["Released under the MIT License. " * 16_000], pa.large_string()), own.vocabulary).codes
    began = time.process_time()
    found = own.places(codes, licenses.BAND, licenses.COVERAGE)
    assert [x[1:3] for x in found] == [(5 * k, 5 * k + 5) for k in range(16_000)] and {own.names[x[0]] for x in found} == {"MIT-short"}
    assert time.process_time() - began < 15


def aligned(text, template, shift, band):
    """Score of the best local alignment within the band, cell by cell."""
    score, best = {}, 0
    for q in range(len(template)):
        for p in range(max(0, q + shift - band), min(len(text), q + shift + band + 1)):
            s = max(0, score.get((p - 1, q - 1), 0) + (2 if text[p] == template[q] else -1), score.get((p - 1, q), 0) - 1, score.get((p, q - 1), 0) - 1)
            score[p, q] = s
            best = max(best, s)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_alignments_are_the_best(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        template, text = rng.integers(0, 3, rng.integers(1, 8)), rng.integers(-1, 3, rng.integers(0, 20))
        shift, band = int(rng.integers(-3, 18)), int(rng.integers(1, 5))
        pairs = licenses.align(text, template, shift, band)
        assert all(text[p] == template[q] and abs(p - q - shift) <= band for p, q in pairs) and pairs == sorted(pairs)
        best = aligned(text.tolist(), template.tolist(), shift, band)
        assert bool(pairs) == (best > 0) and 2 * len(pairs) >= best
        at = licenses.whole(text, template, shift, band)
        if at is not None:
            assert (text[at : at + len(template)] == template).all() and best == 2 * len(template) and pairs == [(at + k, k) for k in range(len(template))]


def test_one_word_over_and_over_is_tiled_in_little_memory():
    block = decontaminate.Items([7, 8], ["a " * 600, "a " * 300 + "b " * 600], 4, 0.5)
    tracemalloc.start()
    began = time.process_time()
    found = block.search(pa.array(["a " * 20_000]))
    assert [(d, i, tiles) for d, i, tiles in found] == [(0, 0, [(0, 0, 600)])]
    assert time.process_time() - began < 10 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


@pytest.mark.parametrize("seed", range(30))
def test_tiles_along_diagonals_are_those_of_seeds(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    pick = lambda n, kinds: " ".join("abcd"[k] for k in rng.integers(0, kinds, n))
    item, text = pick(int(rng.integers(1, 25)), 2), pick(int(rng.integers(0, 80)), 3)
    plain = decontaminate.Items([0], [item], 4, 0.5).search(pa.array([text]))
    monkeypatch.setattr(decontaminate, "SEEDS", -1)
    monkeypatch.setattr(decontaminate, "CELLS", 50)
    assert decontaminate.Items([0], [item], 4, 0.5).search(pa.array([text])) == plain


def lines_of(page):
    return [b["text"] for b in extract.blocks_of(page)[1]]


@pytest.mark.parametrize("depth", [10, 198, 205, 3000, 20_000])
def test_marks_count_at_any_depth(depth):
    page = "<article>" + "<div>" * depth + "<nav>menu <b>more</b><div>deep menu</div></nav><p>text</p><form>field</form>" + "</div>" * depth + "<p>after</p></article>"
    assert lines_of(page) == ["text", "after"]
    assert len(extract.blocks_of(page)[0]) < 10_000


def test_only_the_named_regions_go():
    inside = "<section class='related'>a</section><p class='copyright'>b</p><p id='social'>c</p><div class='recommended'>d</div><p aria-hidden='true'>e</p><fieldset>f</fieldset>"
    assert lines_of(f"<article>{inside}</article>") == ["a", "b", "c", "d", "e", "f"]
    gone = "<nav>a</nav><div class='ad'>b</div><div id='cookie-notice'>c</div><form>d<fieldset>e</fieldset></form><div class='comments'>f</div><aside>g</aside><footer>h</footer><p hidden>i</p>"
    assert lines_of(f"<article>{gone}<p>text</p></article>") == ["text"]


def test_references_are_decoded_piece_by_piece():
    assert lines_of("<p>AT&<b>amp;</b>T &eacute;&#32;&nbsp; x &am<!-- -->p;</p>") == ["AT&amp;T é x &amp;"]


def test_lines_are_written_once(spark, monkeypatch):
    """Every line goes to the shared folder once, and of classes only those of lines that may recur."""
    rows, plain = {}, linedup.stored

    def stored(df, what, **how):
        out = plain(df, what, **how)
        rows[what] = rows.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(linedup, "stored", stored)
    texts = [(i, "\n".join([f"only w{i} x{i} y{i} z{i}", f"another{i} line of its own {i * 7}", "one line that all have", f"pair {i // 2} p q r"])) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    gone = {(r.doc_id, r.line_no): (r.to_doc_id, r.to_line_no) for r in linedup.removals(docs).collect()}
    assert gone == {(i, 2): (0, 2) for i in range(1, 40)} | {(i, 3): (i - 1, 3) for i in range(1, 40, 2)}
    assert sum(n for what, n in rows.items() if what in ("lines", "parts")) == 160 and rows.get("classes", 0) == 0 and rows["equal"] < 60
    twice = docs.unionByName(docs.where("doc_id < 5"))  # rows that repeat an id and its text count once
    assert {(r.doc_id, r.line_no): (r.to_doc_id, r.to_line_no) for r in linedup.removals(twice).collect()} == gone


def test_words_are_hashed_as_they_are_cut():
    """Hashes fall together as the words do, whatever stands at the borders of texts, blocks and slices."""
    long = "x" * 64
    texts = ["", None, " \t", "One two\x0bONE", "two", "", "é É é É one", "a\0 a \0a \0", long, long + "x", long + "x " + long + "y", "\r\n\f one", "aé" * 40_000 + " one", "a " * common.BLOCK, "b" * (common.BLOCK - 3) + " border crossing", "Z[@`z{A"]
    for part in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["lost", *texts, "too"]).slice(1, len(texts)), pa.array(texts[:0], pa.string()), pa.array(["", ""])):
        new, plain = common.HashedWords(part), common.Words(part)
        assert new.lengths.tolist() == plain.lengths.tolist() and len(new.ids) == len(plain.ids)
        words = np.asarray(plain.words.to_pylist(), object)[plain.ids]
        pairs = set(zip(words.tolist(), new.hashes[new.ids].tolist()))
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs}) == len(new.hashes)
    alone = common.HashedWords(pa.array([long + "y"]))  # the same hash in each slice
    assert alone.hashes[0] in common.HashedWords(pa.array(texts)).hashes


def test_groups_of_candidates_are_searched_together(monkeypatch):
    """Groups of up to 1024 rows are paired in strides over all of them, not one after another, and lengths that can't match
    aren't paired; the rows found are those of all pairs."""
    rng, sizes = np.random.default_rng(5), [40] * 300 + [700, 1500, 1, 2]
    g = np.repeat(rng.permutation(len(sizes)) - 9, sizes)
    total = len(g)
    n = rng.integers(10, 90, total)
    at = rng.integers(0, 1 + n // 5)
    s1, s2 = (rng.integers(0, 1 << 60, len(sizes) + 9)[g] ^ 1 << rng.integers(0, 50, total) ^ 1 << rng.integers(0, 50, total) for _ in range(2))
    n_before = np.minimum(at, rng.integers(0, 5, total))
    before = rng.integers(0, 300, int(n_before.sum()))
    side = np.where(rng.random(total) < 0.5, -1, rng.integers(0, 2, total))
    words = np.full((total, 4), -1)
    words[np.arange(4) < n_before[:, None]] = before
    x = {"g": g, "c": np.arange(total), "n": n.astype(np.int32), "at": at.astype(np.int32), "s1": s1, "s2": s2, "side": side.astype(np.int32), "before": before.astype(np.int32), "n_before": n_before.astype(np.int32)}
    want = set()
    for k in np.unique(g):
        r = np.flatnonzero(g == k)
        a, b = r[:, None], r[None, :]
        need = linedup.needed(n[a], n[b])
        ok = (a != b) & (need <= np.minimum(n[a], n[b])) & (np.minimum(at[a], at[b]) + 1 + np.minimum(n[a] - at[a], n[b] - at[b]) - 1 >= need)
        ok &= (side[a] < 0) | (side[a] != side[b])
        ok &= np.bitwise_count(s1[a] ^ s1[b]).astype(int) + np.bitwise_count(s2[a] ^ s2[b]) <= n[a] + n[b] - 2 * need
        for i, j in np.argwhere(ok):
            if not set(words[r[i], : n_before[r[i]]]) & set(words[r[j], : n_before[r[j]]]):
                want |= {r[i], r[j]}
    calls, allowed = [], linedup.Group.allowed
    monkeypatch.setattr(linedup.Group, "allowed", lambda self, a, b: calls.append((a.shape, np.broadcast(a, b).size)) or allowed(self, a, b))
    group = linedup.Group(x)
    assert set(group.x["c"][group.flagged()].tolist()) == want and 100 < len(want) < total
    small = [size for shape, size in calls if len(shape) == 1]
    assert len(small) < 700 and sum(small) < 0.5 * sum(z * (z - 1) // 2 for z in sizes if z <= 1024)
    assert len(calls) - len(small) < 40  # blocks of the one large group

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ALNUM, BLANK, lower
from tallgrass.llm import words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text("aAbB1 \t\n\x0b#é日.", max_size=30), max_size=12), st.integers(1, 40))
def test_words_are_those_of_the_patterns(texts, chunk):
    for letters, pattern, fold in ((words.BLANK_SPLIT, BLANK, False), (words.ALNUM_FOLDED, ALNUM, True), (words.BLANK_SPLIT_FOLDED, BLANK, True)):
        found, hashes = [], {}
        for w in words.chunked(pa.array(texts, pa.string()), letters, chunk):
            for i in range(len(w.lo)):
                own = [bytes(w.data[w.start[j] : w.end[j]]).decode() for j in range(w.lo[i], w.hi[i])]
                own = [lower(x) for x in own] if fold else own
                found.append(own)
                for x, h in zip(own, w.hash[w.lo[i] : w.hi[i]].tolist(), strict=True):
                    assert hashes.setdefault(x, h) == h
        assert found == [pattern.findall(lower(t) if fold else t or "") for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_a_word_longer_than_a_piece():
    long = "x" * 400_000
    chunks = list(words.chunked(pa.array([long + " y", "y " + long]), words.BLANK_SPLIT))
    h = [x for w in chunks for x in w.hash.tolist()]
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    assert words.hashes_of(f"{long} y".encode(), words.BLANK_SPLIT).tolist() == h[:2]

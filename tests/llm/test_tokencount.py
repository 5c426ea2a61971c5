import random

from jsonloom.llm import tokencount


def greedy(text, vocabulary):
    i = n = 0
    while i < len(text):
        for j in range(len(text), i, -1):
            if text[i:j] in vocabulary:
                i, n = j, n + 1
                break
        else:
            n, i = n + len(text[i].encode()), i + 1
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(2)
    for _ in range(300):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        counts = tokencount.Automaton(sorted(vocabulary))
        for _ in range(20):
            text = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 20)))
            assert counts.count(text) == greedy(text, vocabulary), (text, vocabulary)


def test_documents_against_greedy_matching(documents, odd):
    vocabulary = set(tokencount.pieces(tokencount.default_vocabulary()))
    longest = max(map(len, vocabulary))

    def brute(word):
        i = n = 0
        while i < len(word):
            for j in range(min(len(word), i + longest), i, -1):
                if word[i:j] in vocabulary:
                    i, n = j, n + 1
                    break
            else:
                n, i = n + len(word[i].encode()), i + 1
        return n

    for docs in (documents, odd):
        want = sorted(repr((r.doc_id, len((r.text or "").split()), sum(brute("▁" + w) for w in (r.text or "").split()))) for r in docs.collect())
        assert sorted(repr(tuple(r)) for r in tokencount.token_counts(docs).collect()) == want


def test_none(none):
    assert tokencount.token_counts(none).collect() == []

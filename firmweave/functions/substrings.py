"""Which of very many keywords do texts contain? The worker's half of dictionaries from tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 16  # bytes of text that are searched together: their arrays stay in the processor's cache
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
FINER = 2  # bits of the hash by which the marks of filled slots are finer than the slots


def keyword_arrays(words: pa.Table) -> dict:
    """``keyword`` (UTF-8 bytes) and ``cats`` (lists of numbers) as arrays: by length a hash table of the keywords, and marks of what it holds.

    Up to 16 bytes a keyword is one or two words of 8 bytes (its first and its last), which are its hash and what it is compared by;
    longer ones are hashed by a polynomial and compared byte by byte.
    """
    keys = words.column("keyword").to_pylist()
    cats, dense = np.unique(words.column("cats").combine_chunks().flatten().to_numpy(), return_inverse=True)
    counts = words.column("cats").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    sizes, by_size = np.array([len(k) for k in keys], dtype=np.int64), []
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        letters = np.frombuffer(b"".join(keys[i] for i in at.tolist()), dtype=np.uint8).reshape(len(at), n)
        if n <= 16:
            wide = np.zeros((len(at), max(n, 8)), dtype=np.uint8)
            wide[:, :n] = letters
            parts = [np.ascontiguousarray(wide[:, i : i + 8]).view("<u8")[:, 0] for i in ([0, n - 8] if n > 8 else [0])]
            hashes = parts[0] * np.uint64(MIX) + (parts[1] * np.uint64(BASE) if n > 8 else np.uint64(0))
        else:
            power, hashes = 1, np.zeros(len(at), dtype=np.uint64)
            for i in range(n):
                hashes += (letters[:, i].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
                power = power * BASE % (1 << 64)
            parts = [hashes]
            hashes = hashes * np.uint64(MIX)
        if n <= 2:  # one place for each value there is
            table = np.zeros(1 << 8 * n, dtype=np.int32)
            table[parts[0].astype(np.int64)] = np.arange(1, len(at) + 1)
            by_size.append((n, 0, None, table, None, None, at))
            continue
        bits = min(27, max(8, len(at).bit_length() + 2 + FINER))
        fine = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        filled = np.zeros(1 << bits, dtype=bool)
        filled[fine] = True
        slot = fine >> FINER
        order = np.argsort(slot, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << bits - FINER))]).astype(np.int32)
        by_size.append((n, bits, filled, first, [p[order] for p in parts], letters[order] if n > 16 else None, at[order]))
    starts = np.concatenate([[0], np.cumsum(counts)])
    return {"by_size": by_size, "cats": cats, "dense": dense.reshape(-1), "starts": starts, "counts": counts}


def category_counts(shared):
    """The worker function, made here so that it travels whole: (key, text) batches to (key, cat, n), n distinct keywords of the text.

    ``shared`` broadcasts ``keyword_arrays``. Every window of a length is hashed, from its words or for long ones from prefix sums of one
    polynomial; those with a mark are compared with the keywords of their slot, as words or byte by byte, so the result is exact.
    """
    chunk, base, mix, finer = CHUNK, BASE, MIX, FINER

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        d = shared.value
        longest = max(n for n, *_ in d["by_size"])
        size = chunk + max(longest, 16)
        base64, mix64 = np.uint64(base), np.uint64(mix)
        steps = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))])
        power, back = (steps(base), steps(pow(base, -1, 1 << 64))) if longest > 16 else (None, None)
        n_words, n_cats = len(d["counts"]), len(d["cats"])

        def distinct(text, at, n_texts, n_own):
            """Each pair of text and keyword (its number within its length) once."""
            pairs = text * n_own + at
            if n_texts * n_own > 32 * len(pairs) + 1024:
                return np.divmod(np.unique(pairs), n_own)
            marks = np.zeros(n_texts * n_own, dtype=bool)
            marks[pairs] = True
            return np.divmod(np.flatnonzero(marks), n_own)

        def hits(piece, text, left):
            """(number of the text within the piece, keyword number), each pair once, of the keywords that begin at the piece's first places.

            For each of these places ``text`` is its text, ``left`` the bytes from there to the text's end.
            """
            n_starts, n_texts = len(text), int(text[-1]) + 1
            padded = np.zeros(n_starts + 24, dtype=np.uint8)
            padded[: min(len(piece), len(padded))] = piece[: len(padded)]
            word = np.ndarray(n_starts + 16, dtype="<u8", buffer=padded, strides=(1,)).copy()
            mixed, based, sums = word[:n_starts] * mix64, None, None
            for n, bits, filled, first, parts, letters, numbers in d["by_size"]:
                starts = min(n_starts, len(piece) - n + 1)
                if starts <= 0:
                    continue
                if n <= 2:
                    at = first[(word[:starts] & np.uint64((1 << 8 * n) - 1)).view(np.int64)] * (left[:starts] >= n)
                    t, at = distinct(text[:starts], at, n_texts, len(numbers) + 1)
                    yield t[at > 0], numbers[at[at > 0] - 1]
                    continue
                if n <= 8:
                    own = (word[:starts] & np.uint64((1 << 8 * n) - 1), )
                    hashes = own[0] * mix64
                elif n <= 16:
                    based = word * base64 if based is None else based
                    own = (word[:starts], word[n - 8 : n - 8 + starts])
                    hashes = mixed[:starts] + based[n - 8 : n - 8 + starts]
                else:
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)])]) if sums is None else sums
                    own = ((sums[n : n + starts] - sums[:starts]) * back[:starts], )
                    hashes = own[0] * mix64
                fine = (hashes >> np.uint64(64 - bits)).view(np.int64)
                p = np.flatnonzero(filled[fine])
                p = p[left[p] >= n]
                slot, same_text, same_word = fine[p] >> finer, [], []
                at, end = first[slot], first[slot + 1]
                while len(p):
                    same = np.ones(len(p), dtype=bool)
                    for x, y in zip(parts, own):
                        same &= x[at] == y[p]
                    at_same, p_same = at[same], p[same]
                    if letters is not None and len(p_same):
                        equal = (np.lib.stride_tricks.sliding_window_view(piece, n)[p_same] == letters[at_same]).all(axis=1)
                        at_same, p_same = at_same[equal], p_same[equal]
                    same_text.append(text[p_same])
                    same_word.append(at_same)
                    more = at + 1 < end
                    p, at, end = p[more], at[more] + 1, end[more]
                if same_text:
                    t, at = distinct(np.concatenate(same_text), np.concatenate(same_word).astype(np.int64), n_texts, len(numbers))
                    yield t, numbers[at]

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
            ends = ends - ends[0] if len(ends) else ends
            met, open_met = [], np.zeros(0, dtype=np.int64)  # text number * n_words + keyword number; of the text that the next piece goes on with
            for at in range(0, len(data), chunk):
                piece = data[at : at + chunk + longest - 1]
                n_starts = min(chunk, len(data) - at)
                a = int(np.searchsorted(ends, at, side="right")) - 1
                b = int(np.searchsorted(ends, at + n_starts, side="left"))
                text = np.repeat(np.arange(a, b), np.diff(np.clip(ends[a : b + 1], at, at + n_starts)))
                left = ends[text + 1] - np.arange(at, at + n_starts)
                found = np.concatenate([open_met[:0], *((a + t) * n_words + w for t, w in hits(piece, text - a, left))])
                # A long text goes through several pieces; what it has is counted once.
                if len(open_met):
                    own = found < (a + 1) * n_words
                    found = np.concatenate([found[~own], np.unique(np.concatenate([open_met, found[own]]))])
                own = found >= ((b - 1) * n_words if ends[b] > at + n_starts else len(texts) * n_words)
                open_met = found[own]
                met.append(found[~own])
            met = np.concatenate([*met, open_met])
            text, word = met // n_words, met % n_words
            per = d["counts"][word]
            begin = np.repeat(d["starts"][word] - np.concatenate([[0], np.cumsum(per)[:-1]]) if len(per) else per, per)
            pairs = np.repeat(text, per) * n_cats + d["dense"][begin + np.arange(len(begin))]
            if len(batch) * n_cats <= max(len(pairs), 1 << 20):
                n = np.bincount(pairs, minlength=1)
                pairs = np.flatnonzero(n)
                n = n[pairs]
            else:
                pairs, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pairs // n_cats)), pa.array(d["cats"][pairs % n_cats], pa.int64()), pa.array(n, pa.int64())], names=["_key", "cat", "n"])

    return counted

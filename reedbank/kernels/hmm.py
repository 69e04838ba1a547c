"""Profile hidden Markov models of DNA alignments: training, text form, Viterbi alignment, aligned strings.

Position 0 is the begin state.  Transitions of a position are in the order MM, MI, MD, IM, II, DM, DD.  Costs are negative logs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from reedbank.kernels.dirichlet import Prior
from reedbank.kernels.special import bisect

MM, MI, MD, IM, II, DM, DD = range(7)
BACKGROUND_LENGTH = 350
#: Stands for an impossible step, so that running sums stay finite.
FAR = 1e5
MODES = ("GLOBAL", "LOCAL", "NGCL", "CGNL")
PADDING, GAP = ".", "-"


def cost(p) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(-np.log(np.asarray(p, float)), FAR)


@dataclass
class Profile:
    """em, ei: (K + 1, 4) emissions of match and insert states; t: (K + 1, 7) transitions; columns: each position's alignment column, from 1."""

    em: np.ndarray
    ei: np.ndarray
    t: np.ndarray
    columns: np.ndarray
    width: int
    consensus: str = ""
    name: str = ""
    tags: dict = field(default_factory=dict)
    mode: str = "GLOBAL"

    @property
    def size(self) -> int:
        return len(self.em) - 1

    def loops(self) -> tuple[float, float]:
        """Probabilities of staying in front of, and behind, the profile."""
        k = max(self.size, BACKGROUND_LENGTH)
        stay = 1 - k / (k + 1)
        return (stay if self.mode in ("LOCAL", "CGNL") else 0.0), (stay if self.mode in ("LOCAL", "NGCL") else 0.0)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of entering at, and leaving from, each position; runs of deletions at the wings are part of them."""
        k, t = self.size, self.t
        enter, leave = np.full(k + 1, t[0, MM]), np.full(k + 1, t[k, MM])
        run = np.concatenate([[1.0], np.cumprod(t[1:, DD])])  # run[i]: DD of positions 1..i
        for j in range(2, k + 1):
            enter[j] += t[0, MD] * run[j - 2] * t[j - 1, DM]
        back = 1.0
        for i in range(k - 1, 0, -1):
            leave[i] += t[i, MD] * back * t[k, DM]
            back *= t[i, DD]
        enter[0] = leave[0] = 0.0
        return np.minimum(enter, 1.0), np.minimum(leave, 1.0)

    def mean_entropy(self, background=None) -> float:
        """Mean relative entropy of the match emissions, in bits."""
        q = np.full(4, 0.25) if background is None else np.asarray(background)
        p = self.em[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.where(p > 0, p * np.log2(p / q), 0.0).sum(1).mean())


# ---- training


@dataclass
class Counts:
    """Weighted counts of an alignment: emissions (K + 1, 4), transitions (K + 1, 7)."""

    em: np.ndarray
    ei: np.ndarray
    t: np.ndarray
    columns: np.ndarray
    width: int
    n: float


def estimate(counts: Counts, prior: Prior, scale: float = 1.0) -> Profile:
    """Posterior means of scaled counts; the steps that can't happen at the ends are set."""
    k = len(counts.em) - 1
    em, ei = prior.match.posterior_mean(counts.em * scale), prior.insert.posterior_mean(counts.ei * scale)
    t = np.hstack([prior.from_match.posterior_mean(counts.t[:, :3] * scale), prior.from_insert.posterior_mean(counts.t[:, 3:5] * scale), prior.from_delete.posterior_mean(counts.t[:, 5:] * scale)])
    t[0, DM], t[0, DD] = 1.0, 0.0
    t[k, [MM, MI]] /= max(1e-300, t[k, MM] + t[k, MI])
    t[k, MD], t[k, DM], t[k, DD] = 0.0, 1.0, 0.0
    consensus = " " + "".join("ACGT"[i] for i in em[1:].argmax(1))
    return Profile(em, ei, t, counts.columns, counts.width, consensus)


def build(counts: Counts, prior: Prior, target: float = 1.0, name: str = "") -> Profile:
    """A profile whose counts are scaled to the number of sequences that gives the target mean relative entropy."""
    gain = lambda x: estimate(counts, prior, x / counts.n).mean_entropy() - target
    effective = bisect(gain, 0.0, counts.n, 1e-6)
    out = estimate(counts, prior, (counts.n if math.isnan(effective) else effective) / counts.n)
    out.name = name
    out.tags |= {"NSEQ": f"{counts.n:g}", "EFFN": f"{counts.n if math.isnan(effective) else effective:g}"}
    return out


def count_alignment(rows: list[str], weights=None, match_fraction: float = 0.5) -> Counts:
    """Counts from aligned rows held in memory; the tables of operators.msa give the same from Spark."""
    n, width = len(rows), len(rows[0])
    w = np.ones(n) if weights is None else np.asarray(weights, float)
    codes = np.array([["ACGT".find(c) for c in r.upper()] for r in rows])
    is_match = ((codes >= 0) * w[:, None]).sum(0) / w.sum() >= match_fraction
    columns = np.concatenate([[0], np.flatnonzero(is_match) + 1])
    k = len(columns) - 1
    em, ei, t = np.zeros((k + 1, 4)), np.zeros((k + 1, 4)), np.zeros((k + 1, 7))
    index = np.cumsum(is_match)
    step = {"MM": MM, "MI": MI, "MD": MD, "IM": IM, "II": II, "DM": DM, "DD": DD}
    for row, weight in zip(codes, w, strict=True):
        states = [("M", 0)]
        for j, c in enumerate(row):
            kind = ("M" if c >= 0 else "D") if is_match[j] else ("I" if c >= 0 else "")
            if not kind:
                continue
            if c >= 0:
                (em if kind == "M" else ei)[index[j], c] += weight
            states.append((kind, int(index[j])))
        states.append(("M", k + 1))
        for (a, i), (b, _) in zip(states[:-1], states[1:], strict=True):
            if a + b in step:
                t[i, step[a + b]] += weight
    return Counts(em, ei, t, columns, width, float(w.sum()))


# ---- text form


def write_profile(p: Profile) -> str:
    value = lambda x: "*" if x <= 0 else f"{-math.log(x):.5f}"
    row = lambda xs: "  ".join(map(value, xs))
    head = {"NAME": p.name or "profile", "LENG": p.size, "ALPH": "DNA", "MAP": "yes", "CONS": "yes", "WIDTH": p.width} | p.tags
    out = ["HMMER3/f [profile of an alignment]", *[f"{k:<6}{v}" for k, v in head.items()], "HMM          A        C        G        T", "            m->m     m->i     m->d     i->m     i->i     d->m     d->d"]
    out += [f"  COMPO   {row(p.em[1:].mean(0))}"]
    for j in range(p.size + 1):
        if j:
            out.append(f"  {j:>5}   {row(p.em[j])} {p.columns[j]} {p.consensus[j : j + 1] or '-'} - -")
        out += [f"          {row(p.ei[j])}", f"          {row(p.t[j])}"]
    return "\n".join([*out, "//"]) + "\n"


def read_profile(text: str) -> Profile:
    """The text form with ALPH DNA and MAP yes; '*' is an impossible event."""
    lines = text.splitlines()
    if not lines or not lines[0].startswith("HMMER3/f"):
        raise ValueError("not a profile of version 3/f")
    prob = lambda x: 0.0 if x == "*" else math.exp(-float(x))
    tags, at = {}, 1
    while not lines[at].startswith("HMM "):
        key, _, value = lines[at].partition(" ")
        tags[key] = value.strip()
        at += 1
    if tags.get("ALPH", "").upper() != "DNA" or tags.get("MAP", "").lower() != "yes":
        raise ValueError("a DNA profile with mapped columns is needed")
    at += 2
    k = int(tags["LENG"])
    em, ei, t, columns, cons = np.zeros((k + 1, 4)), np.zeros((k + 1, 4)), np.zeros((k + 1, 7)), np.zeros(k + 1, int), [" "]
    if lines[at].split()[0] == "COMPO":
        at += 1
    for j in range(k + 1):
        if j:
            parts = lines[at].split()
            em[j], columns[j] = [prob(x) for x in parts[1:5]], int(parts[5])
            cons.append(parts[6] if len(parts) > 6 else "-")
            at += 1
        ei[j] = [prob(x) for x in lines[at].split()[:4]]
        t[j] = [prob(x) for x in lines[at + 1].split()[:7]]
        at += 2
    width = int(tags.pop("WIDTH", columns[-1]))
    rest = {a: b for a, b in tags.items() if a not in ("NAME", "LENG", "ALPH", "MAP", "CONS")}
    return Profile(em, ei, t, columns, width, "".join(cons), tags.get("NAME", ""), rest)


# ---- alignment


@dataclass
class Alignment:
    seq_start: int
    seq_end: int
    hmm_start: int
    hmm_end: int
    cs_start: int
    cs_end: int
    cost: float
    alignment: str


class Aligner:
    """Viterbi alignment of reads to one profile, for a batch of reads of one length at a time.

    A row of the matrices is computed for all positions and reads at once.  Deletions, which run along the row, are a running minimum of match costs less the
    running sum of deletion costs."""

    def __init__(self, profile: Profile):
        p, self.p = profile, profile
        self.t = cost(p.t).T
        self.em, self.ei = cost(p.em), cost(p.ei)
        enter, leave = p.entries()
        self.enter, self.leave = cost(enter), cost(leave)
        n_loop, c_loop = p.loops()
        self.n_loop, self.c_loop, self.n_out = cost(n_loop), cost(c_loop), cost(1 - n_loop)
        self.deleted = np.concatenate([[0.0], np.cumsum(self.t[DD])])  # deleted[j]: DD of positions 0..j-1

    def align(self, codes: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[tuple[float, list]]:
        """(cost, path) of each row of codes (B, N); path: (state, read position from 1, profile position).  low, high: by read position, the
        first and last profile position that is looked at (a band); costs beyond FAR mean that there is no alignment.  Of equal costs the path that
        begins here goes before one from M, I and D, in this order."""
        b, n = codes.shape
        k, t = self.p.size, self.t
        codes = np.maximum(codes, 0)
        inf = np.full((b, k + 1), FAR)
        m, ins, dele = inf.copy(), inf.copy(), inf.copy()
        from_m, from_i, from_d = (np.zeros((n + 1, b, k + 1), np.uint8) for _ in range(3))
        best, where = np.full(b, np.inf), np.zeros((b, 2), int)
        for i in range(1, n + 1):
            start = self.n_out + (self.n_loop * (i - 1) if i > 1 else 0.0)
            x = codes[:, i - 1]
            lo, hi = (1, k) if low is None else (max(1, int(low[i - 1])), min(k, int(high[i - 1])))
            new_m, new_i, new_d = (np.full((b, k + 1), FAR) for _ in range(3))
            if lo <= hi:
                here, back = slice(lo, hi + 1), slice(lo - 1, hi)
                options = np.stack([np.broadcast_to(start + self.enter[here], (b, hi - lo + 1)), m[:, back] + t[MM, back], ins[:, back] + t[IM, back], dele[:, back] + t[DM, back]])
                choice = options.argmin(0)
                new_m[:, here] = np.take_along_axis(options, choice[None], 0)[0] + self.em[here, :][:, x].T
                from_m[i, :, here] = choice
                stay = np.stack([m[:, here] + t[MI, here], ins[:, here] + t[II, here]])
                new_i[:, here] = stay.min(0) + self.ei[here, :][:, x].T
                from_i[i, :, here] = stay.argmin(0)
                # opening at l costs MD of l; then DD of l + 1 .. j - 1
                last_d = min(hi, k - 1)
                if last_d > lo:
                    opened = new_m[:, lo:last_d] + t[MD, lo:last_d] - self.deleted[lo + 1 : last_d + 1]
                    running = np.minimum.accumulate(opened, axis=1)
                    new_d[:, lo + 1 : last_d + 1] = np.minimum(running + self.deleted[lo + 1 : last_d + 1], FAR)
                    from_d[i, :, lo + 1 : last_d + 1] = opened > running + 1e-12
            m, ins, dele = np.minimum(new_m, FAR), np.minimum(new_i, FAR), new_d
            out = self.c_loop * (n - i) if n > i else 0.0
            ends = m + self.leave + out
            j = ends.argmin(1)
            value = ends[np.arange(b), j]
            last = ins[:, k] + t[IM, k] + out
            j, value = np.where(last < value, k + 1, j), np.minimum(value, last)
            better = value < best
            best = np.where(better, value, best)
            where[better] = np.stack([np.full(b, i), j], 1)[better]
        return [(float(best[r]), self._path(r, *map(int, where[r]), from_m, from_i, from_d) if best[r] < FAR else []) for r in range(b)]

    def _path(self, r: int, i: int, j: int, from_m, from_i, from_d) -> list:
        state = "M"
        if j > self.p.size:
            state, j = "I", self.p.size
        path = []
        while True:
            path.append((state, i, j))
            if state == "M":
                c = from_m[i, r, j]
                if c == 0:
                    return path[::-1]
                i, j, state = i - 1, j - 1, "BMID"[c]
            elif state == "I":
                c = from_i[i, r, j]
                i, state = i - 1, "MI"[c]
            else:
                c = from_d[i, r, j]
                j, state = j - 1, "MD"[c]

    def to_alignment(self, read: str, found: tuple[float, list]) -> Alignment | None:
        """The read in the alignment's columns: '.' where it doesn't reach, '-' for gaps, lower case for inserted bases."""
        value, path = found
        if not path:
            return None
        p, cols = self.p, self.p.columns
        ends = [x for x in path if x[0] != "D"]
        hmm = [j for s, _, j in path if s == "M"]
        i0, i1 = ends[0][1], ends[-1][1]
        out = [PADDING] * (p.width + 1)
        start, end = int(cols[hmm[0]]), int(cols[hmm[-1]])
        for c in range(start, end + 1):
            out[c] = GAP
        inserted: dict[int, str] = {}
        for s, i, j in path:
            if s == "M":
                out[cols[j]] = read[i - 1].upper()
            elif s == "I":
                inserted[j] = inserted.get(j, "") + read[i - 1].lower()
        for j, text in inserted.items():
            first, last = int(cols[j]) + 1, (int(cols[j + 1]) if j < p.size else p.width + 1) - 1
            for c, letter in zip(range(first, last + 1), justified(text, last - first + 1), strict=True):
                if letter != GAP:
                    out[c] = letter
        # unaligned ends of the read stand beside the aligned part, as far as there is room
        head, tail = read[: i0 - 1].lower(), read[i1:].lower()
        for back, letter in enumerate(reversed(head), 1):
            if start - back >= 1:
                out[start - back] = letter
        for ahead, letter in enumerate(tail, 1):
            if end + ahead <= p.width:
                out[end + ahead] = letter
        return Alignment(i0, i1, hmm[0], hmm[-1], start, end, value, "".join(out[1:]))


def justified(text: str, width: int) -> str:
    """Text in width columns: its first half at the left, its second at the right; what doesn't fit is left out in the middle."""
    if len(text) > width:
        half = (width + 1) // 2
        return text[:half] + (text[len(text) - (width - half) :] if width > half else "")
    half = (len(text) + 1) // 2
    return text[:half] + GAP * (width - len(text)) + text[half:]


def merge_mates(a: Alignment, b: Alignment) -> Alignment:
    """One alignment of two mates; the first one's letters win, except for padding."""
    both = "".join(x if x != PADDING else y for x, y in zip(a.alignment, b.alignment, strict=True))
    low, high = min(a.cs_start, b.cs_start), max(a.cs_end, b.cs_end)
    both = "".join(GAP if c == PADDING and low <= i <= high else c for i, c in enumerate(both, 1))
    return Alignment(min(a.seq_start, b.seq_start), max(a.seq_end, b.seq_end), min(a.hmm_start, b.hmm_start), max(a.hmm_end, b.hmm_end), low, high, a.cost + b.cost, both)


def band(seeds: list[tuple[int, int, int, int]], n: int, k: int, slack: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) profile positions for read positions 1..n, around seeds (read from, read to, profile from, profile to)."""
    low, high = np.full(n, k, int), np.zeros(n, int)

    def allow(i: int, a: float, z: float) -> None:
        if 1 <= i <= n:
            low[i - 1], high[i - 1] = min(low[i - 1], max(1, int(math.floor(a)))), max(high[i - 1], min(k, int(math.ceil(z))))

    seeds = sorted(seeds)
    first, last = seeds[0], seeds[-1]
    reach = math.ceil((1 + slack) * first[0])
    for i in range(1, first[0]):
        allow(i, first[2] - reach, first[2])
    for s, following in zip(seeds, [*seeds[1:], None], strict=True):
        more = abs((s[3] - s[2]) - (s[1] - s[0])) + 2
        for i in range(s[0], s[1] + 1):
            at = s[2] + (i - s[0]) * (s[3] - s[2]) / max(1, s[1] - s[0])
            allow(i, at - more, at + more)
        if following:
            for i in range(s[1] + 1, following[0]):
                allow(i, s[3], following[2])
    reach = math.ceil((1 + slack) * (n - last[1]))
    for i in range(last[1] + 1, n + 1):
        allow(i, last[3], last[3] + reach + 1)
    return low, high

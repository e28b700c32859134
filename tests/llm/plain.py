"""Plain versions that several tests compare with."""


def fair_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        part = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if part[s] > repeats * sizes[s] + 1e-9]
        if not over:
            return {s: float(part.get(s, repeats * sizes[s])) for s in names}
        full |= set(over)

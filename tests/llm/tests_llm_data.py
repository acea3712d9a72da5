import random


def _prose(seed: int, parts: list[str], n: int = 120) -> str:
    r = random.Random(seed)
    w = [r.choice(parts) + r.choice(parts) + r.choice(parts) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + 12]) for i in range(0, n, 12))


def rows() -> list[tuple]:
    en, de = ["the", "ing", "tion", "and", "or", "er", "ble"], ["sch", "ung", "keit", "über", "ein", "zu", "pf"]
    out = [(k, _prose(k, de if k % 4 == 0 else en), "de" if k % 4 == 0 else "en", f"s{k % 3}", 0) for k in range(40)]
    near = out[2][1].replace(out[2][1].split()[5], "changed", 1)
    out += [(50, out[2][1], "en", "s0", 0), (51, near, "en", "s0", 0), (90, None, "en", "s1", 0), (91, "", None, None, 0), (92, "12 34", "en", "s1", None)]
    return out

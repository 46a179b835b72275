"""FITS tables and images, from the public standard, with numpy alone."""

from __future__ import annotations

import numpy as np

BLOCK, CARD = 2880, 80
_FORMS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}
_BITPIX = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = text.find("'", 1)
        while text[end : end + 2] == "''":
            end = text.find("'", end + 2)
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def read_header(raw: bytes, at: int) -> tuple[dict, int]:
    """Cards from a block boundary (HISTORY and COMMENT as lists) and where the data begin."""
    cards: dict = {"HISTORY": [], "COMMENT": []}
    while at < len(raw):
        block = raw[at : at + BLOCK].decode("ascii", "replace")
        at += BLOCK
        for k in range(0, len(block), CARD):
            card = block[k : k + CARD]
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if key in ("HISTORY", "COMMENT"):
                cards[key].append(card[8:].strip())
            elif card[8:10] == "= ":
                cards[key] = _value(card[10:])
    raise ValueError("a header without END")


def _size(h: dict) -> int:
    n = int(np.prod([h[f"NAXIS{i + 1}"] for i in range(h["NAXIS"])])) if h.get("NAXIS", 0) else 0
    return abs(h["BITPIX"]) // 8 * h.get("GCOUNT", 1) * (h.get("PCOUNT", 0) + n)


def units(raw: bytes) -> list[tuple[dict, int]]:
    """Header and start of data of every unit in the file."""
    out, at = [], 0
    while at < len(raw):
        h, data = read_header(raw, at)
        out.append((h, data))
        at = data + -(-_size(h) // BLOCK) * BLOCK
    return out


def table(raw: bytes, name: str = "SINGLE DISH") -> tuple[dict, dict, dict[str, np.ndarray]]:
    """Primary header, table header and columns of a binary table."""
    all_ = units(raw)
    for h, at in all_[1:]:
        if h.get("EXTNAME", "").strip() == name:
            kinds, names = [], []
            for i in range(1, h["TFIELDS"] + 1):
                form = h[f"TFORM{i}"].strip()
                n = int(form[:-1] or 1) if form[:-1].isdigit() or not form[:-1] else 1
                kind = _FORMS[form[-1]]
                names.append(h[f"TTYPE{i}"].strip())
                kinds.append((names[-1], f"S{n}") if kind == "S" else (names[-1], kind, (n,)) if n > 1 else (names[-1], kind))
            rows = np.frombuffer(raw, dtype=np.dtype(kinds), count=h["NAXIS2"], offset=at)
            native = {c: rows[c].astype(rows[c].dtype.newbyteorder("=")) if rows[c].dtype.kind in "iuf" else np.char.rstrip(rows[c].astype(str)) for c in names}
            return all_[0][0], h, native
    raise ValueError(f"no table {name}")


def image(raw: bytes, index: int) -> tuple[dict, np.ndarray]:
    h, at = units(raw)[index]
    shape = [h[f"NAXIS{i}"] for i in range(h["NAXIS"], 0, -1)]
    data = np.frombuffer(raw, dtype=_BITPIX[h["BITPIX"]], count=int(np.prod(shape)), offset=at).reshape(shape)
    return h, data.astype(data.dtype.newbyteorder("="))


def _card(key: str, value) -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value):>20.12G}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {text}"[:CARD].ljust(CARD)


def _header(cards: list[tuple[str, object]]) -> bytes:
    lines = [f"{k:<8}{v}"[:CARD].ljust(CARD) if k in ("HISTORY", "COMMENT") else _card(k, v) for k, v in cards]
    text = "".join([*lines, "END".ljust(CARD)])
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


def _padded(data: bytes) -> bytes:
    return data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def image_file(layers: dict[str, np.ndarray], cards: dict) -> bytes:
    """A file with the first layer as the primary image and the others as named extensions."""
    out = b""
    for i, (name, data) in enumerate(layers.items()):
        first = [("SIMPLE", True)] if i == 0 else [("XTENSION", "IMAGE")]
        axes = [("BITPIX", -64), ("NAXIS", data.ndim), *[(f"NAXIS{k + 1}", n) for k, n in enumerate(reversed(data.shape))]]
        rest = [("EXTEND", True)] if i == 0 else [("PCOUNT", 0), ("GCOUNT", 1)]
        out += _header([*first, *axes, *rest, ("EXTNAME", name), *cards.items()]) + _padded(np.asarray(data, ">f8").tobytes())
    return out


def table_file(primary: dict, columns: dict[str, np.ndarray], name: str = "SINGLE DISH", history: list[str] = ()) -> bytes:
    """A file with an empty primary unit and one binary table."""
    letter = {"i": {2: "I", 4: "J", 8: "K"}, "f": {4: "E", 8: "D"}, "u": {1: "B"}}
    kinds, cards = [], []
    for i, (c, v) in enumerate(columns.items(), 1):
        v = np.asarray(v)
        if v.dtype.kind in "US":
            v = v.astype("S")
            form, kind = f"{v.dtype.itemsize}A", (c, v.dtype)
        else:
            n = v.shape[1] if v.ndim == 2 else 1
            form = f"{n}{letter[v.dtype.kind][v.dtype.itemsize]}"
            kind = (c, v.dtype.newbyteorder(">"), (n,)) if v.ndim == 2 else (c, v.dtype.newbyteorder(">"))
        kinds.append(kind)
        cards += [(f"TTYPE{i}", c), (f"TFORM{i}", form)]
    rows = np.zeros(len(next(iter(columns.values()))), dtype=np.dtype(kinds))
    for c, v in columns.items():
        rows[c] = np.asarray(v).astype("S") if np.asarray(v).dtype.kind in "US" else v
    head = _header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), *primary.items(), *[("HISTORY", h) for h in history]])
    body = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)), *cards, ("EXTNAME", name)]
    return head + _header(body) + _padded(rows.tobytes())

"""SuperMinHash signatures of many sets at once, in numpy.

Every element draws one random permutation of the m slots, rank by rank. The value that it
offers to the slot it reaches at rank j lies in [j, j + 1), so ranks of one element are
correlated across slots and a signature varies less than with m separate hashes. A slot that
is filled at rank j can't improve at a later one: a set stops as soon as all its slots are
filled, for long sets after one to three ranks.
"""

from __future__ import annotations

import numpy as np

from .wordhash import U64, combine, mix

EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_STEP = U64(0xD1B54A32D192ED03)


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """Signatures as an array (n_sets, slots).

    ``elements`` are distinct 64-bit hashes of each set, ``owner`` the number of the set of
    each. A value is the rank in the top byte above the random part. Sets without elements
    keep ``EMPTY`` in all slots.
    """
    if slots > 256:
        raise ValueError("at most 256 slots")
    out = np.full(n_sets * slots, EMPTY, U64)
    base = owner.astype(np.int64) * slots
    order = None  # permutation of each element that is still needed
    for rank in range(slots):
        if not len(elements):
            break
        r = mix(elements + U64(int(_STEP) * (rank + 1) % 2**64))
        pick = rank + ((r >> U64(32)) * U64(slots - rank) >> U64(32)).astype(np.int64)
        if rank == 0:
            slot = pick
        else:
            slot = order[np.arange(len(elements)), pick].astype(np.int64)
        value = (U64(rank) << U64(56)) | (mix(r) >> U64(8))
        np.minimum.at(out, base + slot, value)
        going = (out.reshape(n_sets, slots) == EMPTY).any(axis=1)[owner]
        if rank == 0:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(going.sum()), 1))
            order[np.arange(len(order)), pick[going]] = 0
        else:
            order[np.arange(len(elements)), pick] = order[:, rank]
            order = order[going]
        elements, owner, base = elements[going], owner[going], base[going]
    return out.reshape(n_sets, slots)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots, different bands never sharing a key space."""
    n, slots = signature.shape
    bands = slots // rows
    keys = [combine([signature[:, b * rows + i] for i in range(rows)], salt=b + 1) for b in range(bands)]
    return np.stack(keys, axis=1) if n else np.empty((0, bands), U64)

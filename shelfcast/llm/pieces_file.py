"""Reading a SentencePiece model file: its pieces, their scores and kinds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Where the box keeps a public model; the path is a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Pieces:
    """``normal`` maps a piece's bytes to its id; ``bytes_`` has the ids of the 256 byte pieces."""

    normal: dict[bytes, int]
    bytes_: np.ndarray
    scores: np.ndarray
    unknown: int
    names: list[bytes]


def read_pieces(path: str = MODEL, zipf: bool = True) -> Pieces:
    """The pieces of a model on the driver's disk (half a megabyte).

    The scores of a model that was built by merges are negative ranks, no logarithms. With ``zipf``
    such scores (whole numbers that fall by one) become the logarithm of a Zipf distribution over
    the ranks; real log scores stay as they are. Byte pieces come last: a byte is as likely as the
    rarest piece, less ln(256).
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)], float)
    plain = [
        i for i in range(n)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    own = scores[plain]
    if zipf and len(plain) > 1 and (own == np.rint(own)).all() and (own <= 0).all():
        weight = 1.0 / (2.7 - own)
        scores[plain] = np.log(weight / weight.sum())
    bytes_ = np.full(256, -1, np.int32)
    for i in range(n):
        if model.is_byte(i):
            bytes_[int(names[i][3:5], 16)] = i
    floor = scores[plain].min() if plain else 0.0
    scores[bytes_[bytes_ >= 0]] = floor - np.log(256)
    normal = {names[i].encode(): i for i in plain}
    return Pieces(normal, bytes_, scores, model.unk_id(), [p.encode() for p in names])

"""Public tokenizers for tasks: files are read on the driver, so that executors need none."""

from __future__ import annotations

import json


def load_byte_bpe(path: str | None) -> dict:
    """A byte-level BPE file as {"ranks": bytes -> id, "pattern": split pattern,
    "special": added token -> id, "file": its text}."""
    import public_tokenizers
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    model = json.loads(text)
    # byte-level vocabularies write each byte as a visible character: printable
    # ones as themselves, the others from U+0100 on in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    if any(t.get(flag) for t in model.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in blanks or stand as words only are not supported")
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return {"ranks": ranks, "pattern": public_tokenizers.PATTERN, "special": special, "file": text}


def byte_bpe(loaded: dict, special: bool):
    """text -> ids, as the tokenizers library gives them for this file. With
    ``special`` an added token in a text is one id, else plain text.

    ``tiktoken`` gives the same ids faster, but its split pattern gives up on very
    long runs of blanks; such a text goes to the tokenizers library."""
    import tiktoken
    fast = tiktoken.Encoding("byte-bpe", pat_str=loaded["pattern"], mergeable_ranks=loaded["ranks"], special_tokens=loaded["special"] if special else {})
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all") if special else fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException as e:  # the Rust side raises a panic, which is no Exception
            if "stack" not in str(e).lower() and "backtrack" not in str(e).lower():
                raise
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_str(loaded["file"]))
                slow[0].encode_special_tokens = not special
            return slow[0].encode(text, add_special_tokens=False).ids
    return encode


def load_pieces(path: str | None) -> bytes:
    """A sentencepiece model file."""
    import public_tokenizers
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def piece_bytes(processor) -> list[bytes]:
    """What each id of a sentencepiece model stands for: its piece in UTF-8 with
    U+2581 as a blank, <0xHH> as the byte HH, nothing for control symbols."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        else:
            out.append(b"" if processor.is_control(i) or processor.is_unknown(i) else piece.replace("▁", " ").encode())
    return out

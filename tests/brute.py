"""The scoring rules in plain Python, for comparison on small inputs."""

import re


def _cut(text, separator):
    """Cut at a separator and forget empty pieces at the end."""
    pieces = text.split(separator)
    while len(pieces) > 1 and pieces[-1] == "":
        pieces.pop()
    return pieces


def _score(tokens, words):
    return sum({"positive": 1, "negative": -1}.get(words.get(t), 0) for t in tokens)


def _sign(score):
    return "positive" if score > 0 else "negative" if score < 0 else "mixed"


def clean(text, words, tokenizer):
    if text is None:
        return "mixed"
    tokens = text.split(" ") if tokenizer == "ws" else re.split(r"\W+", text, flags=re.ASCII)
    tokens = [t for t in tokens if t]
    if len(tokens) == 1:
        return words.get(tokens[0]) or "mixed"
    return _sign(_score(tokens, words))


def printed(text, words, tokenizer):
    """Score the printed form of the row, with its brackets around the text."""
    if tokenizer == "ws":
        row, separator = f"[{'null' if text is None else text}]", " "
    elif text is None:
        row, separator = "[null]", ", "
    else:
        tokens = re.split(r"\W+", text, flags=re.ASCII)
        row, separator = f"[[{', '.join(tokens)}]]", ", "
    tokens = _cut(row, separator)
    if len(tokens) <= 1:
        return words.get(row) or "mixed"
    return _sign(_score(tokens, words))

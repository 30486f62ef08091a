"""Chat formatting in budgeted windows.

A conversation's turns, in order, become training windows. Prefix sums of the turns' tokens choose each window's
turn-aligned span: as many new turns as the budget holds after the system turn and a history of at most
``history_tokens`` tokens of the turns before, repeated as context. A window has at least one new turn, however long.
Assistant turns of the new span are the targets; repeated turns and the system turn are masked, so every assistant
text is a target exactly once.

Template: a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts a ``<`` before any number of ``\\`` and a ``|``
gets one more ``\\`` after it; inside roles ``%``, ``<`` and newlines become ``%25``, ``%3C`` and ``%0A``. So control
strings can't appear in either, and ``unescape`` and ``unescape_role`` give them back exactly.

Conversations are range-partitioned and sorted by (conversation, turn); one streaming pass holds the turns of the
window at hand and of its history, never a conversation.

Defined results: null texts and roles are empty; rows with equal turn numbers are ordered by role, then text; a null
conversation id is a conversation; an empty table has no windows; other columns are not read. The system turn is the
conversation's first turn if its role is ``system``; further system turns are ordinary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: target_at, target_len: code points of the window's text under the loss mask; first, n_new: its new turns (0-based).
WINDOW = "window int, first bigint, n_new int, n_repeated int, n_tokens bigint, text string, target_at array<int>, target_len array<int>"


def escape(text: str) -> str:
    return re.sub(r"<(?=\\*\|)", r"<\\", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(?=\\*\|)", "<", text)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text is in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(body)


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted window: role, text, and the span of the escaped text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


_counters: dict[str, Callable] = {}


def token_counter(path: str | None) -> Callable[[list[str]], np.ndarray]:
    """Tokens of texts by a tokenizers file, or words and signs when there is none."""
    key = path or ""
    if key not in _counters:
        if path:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _counters[key] = lambda texts: np.array([len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)], np.int64)
        else:
            word = re.compile(r"\w+|[^\w\s]")
            _counters[key] = lambda texts: np.array([len(word.findall(t)) for t in texts], np.int64)
    return _counters[key]


class Windows:
    """Windows of one conversation, fed turn by turn."""

    def __init__(self, budget: int, history_tokens: int):
        self.budget, self.history_tokens = budget, history_tokens
        self.system: tuple | None = None
        self.past: list[tuple] = []  # turns that the next window may repeat
        self.new: list[tuple] = []
        self.n = self.window = self.first = 0
        self.sums = [0]  # prefix sums of the tokens of the new turns

    def _base(self) -> int:
        return (self.system[3] if self.system else 0) + sum(t[3] for t in self.past)

    def feed(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, self.n, tokens)
        if self.new and self._base() + self.sums[-1] + tokens > self.budget:
            yield self.close()
        self.new.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        self.n += 1

    def close(self) -> tuple:
        parts, at, spots, lens, tokens = [], 0, [], [], 0
        repeated = ([self.system] if self.system else []) + self.past
        for k, (role, text, _, n) in enumerate(repeated + self.new):
            line, head, body = render(role, text)
            if k >= len(repeated) and role == "assistant":
                spots.append(at + head)
                lens.append(body)
            parts.append(line)
            at += len(line)
            tokens += n
        out = (self.window, self.first, len(self.new), len(repeated), tokens, "".join(parts), spots, lens)
        if self.new[0][2] == 0 and self.new[0][0] == "system":
            self.system = self.new[0]
        # History by prefix sums from the end: the longest run of turns within history_tokens.
        pool = [t for t in self.past + self.new if not (self.system and t[2] == 0)]
        sums = np.cumsum([t[3] for t in reversed(pool)])
        room = min(self.history_tokens, self.budget - (self.system[3] if self.system else 0))
        keep = int(np.searchsorted(sums, room, "right"))
        self.past = pool[len(pool) - keep :] if keep else []
        self.window, self.first = self.window + 1, self.n
        self.new, self.sums = [], [0]
        return out


def format_chats(chats: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 2048, history_tokens: int = 512, tokenizer_file: str | None = None) -> DataFrame:
    """(conv_col, window, first, n_new, n_repeated, n_tokens, text, target_at, target_len), a row a window, in order."""
    if budget < 1 or not 0 <= history_tokens < budget:
        raise ValueError("0 <= history_tokens < budget is needed")
    kind = dict(chats.select(F.col(f"`{conv_col}`").alias("c")).dtypes)["c"]
    src = chats.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").alias("n"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    src = src.repartitionByRange("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")

    def windows(batches):
        count = token_counter(tokenizer_file)
        conv, state = object(), None
        for b in batches:
            rows = []
            convs, roles, texts = (b.column(k).to_pylist() for k in range(3))
            for c, r, t, n in zip(convs, roles, texts, count([render(r, t)[0] for r, t in zip(roles, texts)]).tolist()):  # as formatted: with role, template and escapes
                if state is None or c != conv:
                    if state is not None and state.new:
                        rows.append((conv, *state.close()))
                    conv, state = c, Windows(budget, history_tokens)
                rows += [(conv, *w) for w in state.feed(r, t, n)]
            if rows:
                yield _batch(rows)
        if state is not None and state.new:
            yield _batch([(conv, *state.close())])

    conv_type = _arrow_type(kind)

    def _batch(rows):
        cols = list(zip(*rows))
        types = [conv_type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["c", *(x.split()[0] for x in WINDOW.split(", "))])

    return src.mapInArrow(windows, f"c {kind}, {WINDOW}").withColumnRenamed("c", conv_col)


def _arrow_type(kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def read_back(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the windows' texts.

    Takes the windows of format_chats as they come: of a conversation together and in order.
    """
    kind = dict(windows.dtypes)[conv_col]
    conv_type = _arrow_type(kind)

    def digest(batches):
        conv, state, out = object(), None, []
        for b in batches:
            for c, rep, text, at, size in zip(*(b.column(k).to_pylist() for k in range(5))):
                if state is None or c != conv:
                    if state is not None:
                        out.append((conv, *done(state)))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ends = {}
                for role, plain, a, z in parse(text):
                    ends[a] = z
                    if rep > 0:
                        rep -= 1
                        continue
                    state[0] += 1
                    state[1].update(f"{role}\n{plain}\n".encode())
                for a, n in zip(at, size):
                    if ends.get(a) != a + n:
                        raise ValueError("a target is not a turn's text")
                    plain = unescape(text[a : a + n])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
            if out:
                yield batch(out)
                out = []
        if state is not None:
            yield batch([(conv, *done(state))])

    def done(s):
        return s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch(rows):
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return windows.select(conv_col, "n_repeated", "text", "target_at", "target_len").mapInArrow(digest, f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

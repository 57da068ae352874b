"""The question console without a terminal: what each key does to the text, the history and the table on show.

A front end feeds key names to ``Console.press`` and draws the fields; nothing here waits or prints.
While a question is worked on only quitting, clearing and the mouse switch are heard.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from govlake.plans.nlsql import Event, State, step

BUSY = frozenset({State.GENERATING, State.RUNNING, State.RETRYING})
QUIT = "quit"


@dataclass
class Console:
    submit: Callable[[str], None]
    state: State = State.INPUT
    text: str = ""
    history: list[str] = field(default_factory=list)
    place: int = 0  # in the history; its length is the empty line after it
    rows: int = 0  # of the table on show
    row: int = 0  # that is marked
    mouse: bool = True

    @property
    def busy(self) -> bool:
        return self.state in BUSY

    def press(self, key: str) -> str | None:
        """Handle a key: a character, or a name such as ``up`` or ``ctrl+l``. ``QUIT`` means that the user leaves."""
        if key == "ctrl+c" or (key == "q" and not self.busy and not self.text):
            return QUIT
        always = {"ctrl+l": self.clear, "ctrl+m": self._switch_mouse, "wheelup": lambda: self.scroll(-1), "wheeldown": lambda: self.scroll(1)}
        idle = {"enter": self._enter, "up": lambda: self._move(-1), "down": lambda: self._move(1), "backspace": self._rub}
        if key in always:
            always[key]()
        elif not self.busy and key in idle:
            idle[key]()
        elif len(key) == 1:
            self.paste(key)
        return None

    def paste(self, text: str) -> None:
        if not self.busy:
            self.text += text

    def scroll(self, by: int) -> None:
        """Mark another row of the table on show; the ends hold."""
        if self.state is State.DONE and self.rows:
            self.row = max(0, min(self.rows - 1, self.row + by))

    def recall(self, by: int) -> None:
        """An older or newer question; after the newest comes an empty line."""
        place = max(0, min(len(self.history), self.place + by))
        if place != self.place:
            self.place, self.text = place, ([*self.history, ""])[place]

    def show(self, state: State, rows: int = 0) -> None:
        """What became of the question."""
        self.state, self.rows, self.row = state, rows, 0

    def clear(self) -> None:
        self.show(step(self.state, Event.RESET))
        self.text, self.place = "", len(self.history)

    def _switch_mouse(self) -> None:
        self.mouse = not self.mouse

    def _move(self, by: int) -> None:
        self.scroll(by) if self.state is State.DONE else self.recall(by)

    def _rub(self) -> None:
        self.text = self.text[:-1]

    def _enter(self) -> None:
        question = self.text.strip()
        if question:
            self.history.append(question)
            self.text, self.place = "", len(self.history)
            self.show(step(State.INPUT, Event.ASKED))
            self.submit(question)

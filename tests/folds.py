"""Slow per-row folds: the property oracles of the session rules and the liveness check."""

TRIGGERS = {"trigger", "error", "gap", "overflow", "disconnect", "timeout", "request"}


def session_fold(kinds):
    """(open_before, open_after, attempt, ignored, session, seq or None) of each kind in order."""
    is_open = recovering = False
    session = seq = 0
    out = []
    for kind in kinds:
        before, attempt, ignored, number = is_open, False, False, None
        if kind in TRIGGERS or (kind in ("snapshot", "bad_snapshot") and is_open):
            attempt, ignored = not recovering, recovering
            is_open, recovering = False, True
            if attempt:
                session, seq = session + 1, 0
        elif kind == "snapshot":
            is_open, recovering = True, False
            seq += 1
            number = seq
        elif kind in ("update", "trade") and is_open:
            seq += 1
            number = seq
        elif kind == "recovery_failed":
            recovering = False
        out.append((before, is_open, attempt, ignored, session, number))
    return out


def liveness_fold(rows, timeout, horizon, restart=False):
    """(time, applied) of the timeouts of (time, kind) rows, by walking the check grid tick by tick."""
    half, fired = timeout // 2, []
    is_open = recovering = False
    start = last = tick = None

    def request(at, kind):
        """A row or a timeout at the gate; an applied recovery ends the monitoring."""
        nonlocal is_open, recovering, start, tick
        applied = False
        if kind in TRIGGERS or (kind in ("snapshot", "bad_snapshot") and is_open):
            applied = not recovering
            is_open, recovering = False, True
        elif kind == "snapshot":
            is_open, recovering = True, False
        elif kind == "recovery_failed":
            recovering = False
        if applied or kind == "disconnect":
            if restart and start is not None:
                start, tick = at, at + timeout
            else:
                start = tick = None
        return applied

    def run_until(limit):
        nonlocal last, tick
        while start is not None and tick < limit:
            now, tick = tick, tick + half
            if now - last >= timeout:
                last = now
                fired.append((now, request(now, "timeout")))

    for at, kind in rows:
        run_until(at)
        if kind in ("ack", "heartbeat"):
            last = at
            if start is None and (kind == "ack" or restart):
                start, tick = at, at + timeout
        else:
            request(at, kind)
    run_until(horizon)
    return fired


class FeedFold:
    """The order feed, row by row over whole streams: what each row becomes, and who asked for recovery."""

    def __init__(self, slots, timeout):
        self.slots, self.timeout = slots, timeout
        self.gate = self.recovering = False
        self.buffer = []
        self.session = self.sent = 0
        self.clock = self.grid = None
        self.asked, self.labels = [], {}

    def recover(self, cause, pos, at):
        applied = not self.recovering
        if applied:
            for p, _ in self.buffer or ():
                self.label(p, "pre_snapshot")
            self.session, self.sent, self.buffer = self.session + 1, 0, []
            self.gate, self.recovering = False, True
            if self.grid is not None:
                self.grid = at + self.timeout
        if applied or cause != "disconnect":
            self.asked.append((pos, self.session, at, cause, applied))
        return applied

    def label(self, pos, outcome, number=None, session=None):
        self.labels[pos] = (self.session if session is None else session, outcome, number)

    def send(self, pos, outcome):
        self.sent += 1
        self.label(pos, outcome, self.sent)

    def document(self, pos, boundary, at):
        waiting, self.buffer = self.buffer, None
        self.gate = True
        self.send(pos, "accepted_snapshot")
        expected, broken = None, False
        for p, seq in waiting:
            if expected is None and seq <= boundary:
                self.label(p, "stale")
                continue
            expected = boundary + 1 if expected is None else expected
            if broken or seq != expected:
                self.label(p, "dropped" if broken else "gap")
                broken = True
                continue
            expected += 1
            self.send(p, "replayed")
        if broken:
            self.recover("gap", pos, at)
        else:
            self.recovering = False

    def run(self, rows, horizon):
        """rows of (pos, kind, at, seq)."""
        for pos, kind, at, seq in [*rows, (rows[-1][0] + 1, "end", horizon, None)]:
            while self.grid is not None and self.grid < at:
                now, self.grid = self.grid, self.grid + self.timeout // 2
                if now - self.clock >= self.timeout:
                    self.clock = now
                    self.recover("timeout", pos - 1, now)
            if kind in ("update", "trade"):
                if self.gate:
                    self.send(pos, "published")
                else:
                    self.label(pos, "pre_snapshot")
                    if self.buffer is not None and len(self.buffer) == self.slots - 1:
                        for p, _ in self.buffer:
                            self.label(p, "pre_snapshot")
                        self.buffer = None
                        self.recover("overflow", pos, at)
                    elif self.buffer is not None:
                        self.buffer.append((pos, seq))
                continue
            if kind == "snapshot" and self.buffer is not None:
                self.document(pos, seq, at)
                continue
            self.label(pos, "ignored_snapshot" if kind == "snapshot" else kind)
            if kind == "bad_snapshot" and self.buffer is not None:
                for p, _ in self.buffer:
                    self.label(p, "pre_snapshot")
                self.buffer = None
                self.recover("refused", pos, at)
            elif kind in ("ack", "heartbeat"):
                self.clock = at
                self.grid = at + self.timeout if self.grid is None else self.grid
            elif kind == "recovery_failed":
                self.recovering = False
            elif kind in TRIGGERS and not self.recover(kind, pos, at) and kind == "disconnect" and self.grid is not None:
                self.grid = at + self.timeout
        del self.labels[rows[-1][0] + 1]
        return self

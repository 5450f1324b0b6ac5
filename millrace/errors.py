class InvalidInput(ValueError):
    """A request names a column, type, label or table that does not fit its inputs."""


class PolicyBlocked(RuntimeError):
    """A label on the input forbids the requested step."""


class ChecksFailed(RuntimeError):
    """A version was not committed, as checks on its rows failed. `results`: what each check gave."""

    def __init__(self, results: list[dict]):
        super().__init__(f"checks failed: {[r['name'] for r in results if r['status'] == 'fail']}")
        self.results = results


class StepAborted(RuntimeError):
    """An answer function refused in a way that makes further calls pointless."""

    def __init__(self, code: str):
        super().__init__(f"answers stopped: {code}")
        self.code = code

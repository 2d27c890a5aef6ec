"""Errors that scripts can cause."""


class ScriptError(Exception):
    """Base of all errors of the engine."""


class SyntaxFault(ScriptError):
    """The text is not in the language."""


class Unsupported(ScriptError):
    """The language has it, this engine does not."""


class PlanFault(ScriptError):
    """Names, types or constants that can't work; found before anything runs."""


class RunFault(ScriptError):
    """A failure while a statement runs."""

"""Errors of scripts, with the position they refer to where one is known."""

from __future__ import annotations


class VtlError(Exception):
    """Base of all script errors. ``pos`` is (line, column), zero-based."""

    def __init__(self, message: str, pos: tuple[int, int] | None = None):
        super().__init__(message)
        self.message, self.pos = message, pos


class VtlSyntaxError(VtlError):
    pass


class UndefinedVariable(VtlError):
    def __init__(self, name: str, pos=None):
        super().__init__(f"undefined variable {name}", pos)


class AlreadyDefined(VtlError):
    pass


class FunctionNotFound(VtlError):
    def __init__(self, signature: str, pos=None):
        super().__init__(f"function '{signature}' not found", pos)


class InvalidType(VtlError):
    def __init__(self, got: str, expected: str, pos=None):
        super().__init__(f"invalid type {got}, expected {expected}", pos)


class ConflictingTypes(VtlError):
    def __init__(self, types, pos=None):
        super().__init__(f"conflicting types: [{', '.join(types)}]", pos)


class InvalidArgument(VtlError):
    pass


class NotImplementedFunction(VtlError):
    def __init__(self, name: str, pos=None):
        super().__init__(f"the function {name} is not yet implemented", pos)


class MultipleAssignment(VtlError):
    pass


class CycleError(VtlError):
    pass


class ScriptErrors(VtlError):
    """Several errors found in one pass."""

    def __init__(self, errors: list[VtlError]):
        super().__init__("; ".join(e.message for e in errors), errors[0].pos)
        self.errors = errors

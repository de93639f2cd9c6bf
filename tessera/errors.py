"""Failures with a stable code. Row-level ones become data; those of configurations are raised."""

from __future__ import annotations


class CodecError(ValueError):
    def __init__(self, code: str, message: str, offset: int | None = None, related: int | None = None, violation: str | None = None, end: int | None = None):
        super().__init__(message)
        self.code, self.message, self.offset, self.related, self.violation = code, message, offset, related, violation
        self.end, self.place = end, None  # where the fault ends, and the item that it is in, if known


def invalid_input(message: str) -> CodecError:
    return CodecError("ERR_INVALID_INPUT", message)


#: Every code that an operator may report.
CODES = (
    "ERR_BATCH_ITEM", "ERR_BATCH_LIMIT", "ERR_INVALID_EXECUTION_POLICY", "ERR_COMPRESSION_VALUE_TOO_LARGE", "ERR_INVALID_ENCODED_CONTEXT",
    "ERR_INVALID_INPUT", "ERR_UNDEFINED_COMPRESSED_CONTEXT", "ERR_UNKNOWN_COMPRESSED_VALUE", "ERR_UNRECOGNIZED_BYTES",
    "ERR_UNSUPPORTED_JSON_TYPE", "ERR_COMPUTE_FAMILY_UNAVAILABLE", "ERR_UNPINNED_CONTEXT", "ERR_UNPINNED_DICTIONARY", "ERR_INTEGER_OVERFLOW",
    "ERR_INVALID_COMPUTE_OUTPUT", "ERR_NOT_CBOR", "ERR_INTEGRITY_MISMATCH", "ERR_INVALID_DIGEST", "ERR_INVALID_MANIFEST",
    "ERR_INVALID_CONTEXT", "ERR_INVALID_TERM_DEFINITION", "ERR_NO_DOCUMENT_LOADER", "ERR_PROTECTED_TERM_REDEFINITION",
    "ERR_UNKNOWN_CBORLD_TERM_ID", "ERR_INVALID_DICTIONARY", "ERR_INVALID_TYPETABLE", "ERR_NON_PREFERRED_CBOR", "ERR_NON_PREFERRED_FLOAT",
    "ERR_NON_PREFERRED_INTEGER", "ERR_NON_PREFERRED_LENGTH", "ERR_RESERVED_SIMPLE_VALUE", "ERR_RESOURCE_LIMIT", "ERR_NOT_CBORLD",
    "ERR_NO_TYPETABLE", "ERR_UNSUPPORTED_FORMAT", "ERR_UNSUPPORTED_LITERAL_TYPE", "ERR_POLICY_MISMATCH", "ERR_UNKNOWN_CONTEXT",
)

"""A conversion that fails says why; callers turn this into an error column, never into a failed task."""


class ConversionError(Exception):
    pass


class UnsupportedCodec(ConversionError):
    def __init__(self, what: str) -> None:
        super().__init__(f"Unsupported codec in this build: {what}")


def utf8(data: bytes, what: str = "Invalid UTF-8") -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ConversionError(f"{what}: invalid byte at position {e.start}") from None

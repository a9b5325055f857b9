from weirline.functions.casts import field, parse_date, strict_cast

__all__ = ["field", "parse_date", "strict_cast"]

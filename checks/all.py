"""Import every case module."""

from . import cases_core, cases_us, cases_intl, cases_hedge  # noqa: F401

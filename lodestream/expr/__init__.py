"""Typed column expressions."""

from lodestream.expr.ast import Expr, col, datetime, from_epoch, lit, make_struct, now, repeat, var, when

__all__ = ["Expr", "col", "datetime", "from_epoch", "lit", "make_struct", "now", "repeat", "var", "when"]

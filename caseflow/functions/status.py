"""Encodings of device and command-echo fields. Arguments are VARIANT values, possibly missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.variants import is_absent, number_of, string_of


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def bgp_down(value: Column) -> Column:
    return F.lit(1) - flag(string_of(value) == vocab.BGP_UP)


def interface_code(value: Column) -> Column:
    text = string_of(value)
    code = F.when(is_absent(value), F.lit(vocab.INTERFACE_MISSING))
    for name, number in vocab.INTERFACE_CODES.items():
        code = code.when(text == name, F.lit(number))
    return code.otherwise(F.lit(vocab.INTERFACE_OTHER))


def not_logged_in(running_time: Column) -> Column:
    return F.lit(1) - flag(number_of(running_time) >= 0)


def rebooted(running_time: Column, alarm_time: Column) -> Column:
    late = number_of(running_time) - number_of(alarm_time) + F.lit(float(vocab.REBOOT_WINDOW_MS)) > 0
    return F.lit(1) - flag(late)


def foreign_owner(value: Column) -> Column:
    return F.lit(1) - flag(string_of(value).contains(vocab.OWNER_MARK))


def resource_abnormal(value: Column) -> Column:
    normal = is_absent(value) | F.coalesce(string_of(value).isin("", vocab.RESOURCE_RUNNING), F.lit(False))
    return F.lit(1) - flag(normal)


def is_vlan(value: Column) -> Column:
    return flag(string_of(value).contains(vocab.VLAN_MARK))


def life_cycle_abnormal(value: Column) -> Column:
    normal = is_absent(value) | F.coalesce(string_of(value) == vocab.LIFE_IN_USE, F.lit(False))
    return F.lit(1) - flag(normal)

"""Registered queries; importing the package registers those of every module."""

from roadweave.plans import checks, fitting, reference, small, turnroutes  # noqa: F401

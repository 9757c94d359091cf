"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import palimpsest.functions.shipping as _shipping

_shipping.by_value(__name__)

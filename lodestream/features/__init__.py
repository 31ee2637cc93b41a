"""Featuresets: columns computed from a request by lookups, expressions and Python."""

from lodestream.features.featureset import FeatureError, Featureset, extractor, feature, featureset

__all__ = ["FeatureError", "Featureset", "extractor", "feature", "featureset"]

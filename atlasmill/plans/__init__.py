"""Whole flows: resolving an address list, buffering footprints, enriching results."""

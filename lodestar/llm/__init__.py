"""Training-data operators: filtering, fingerprints, joins, mixing, language ID, tokenising.

One module per operator; ``queries`` registers them for the driver.  Nothing
outside this package imports it.
"""

"""typeahead.operators"""

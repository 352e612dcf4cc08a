"""typeahead.sources"""

"""typeahead.functions"""

"""typeahead.plans"""

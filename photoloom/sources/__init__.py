"""photoloom.sources"""

"""photoloom.functions"""

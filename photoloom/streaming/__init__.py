"""photoloom.streaming"""

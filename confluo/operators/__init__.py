"""confluo.operators"""
